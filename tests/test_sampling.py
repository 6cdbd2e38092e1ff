import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import exact_sample, stratified_holdout, stratified_sample
from tidemark.operators import bounded, sampling


def md5(salt, i):
    return hashlib.md5(f"{salt}{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one cell, one tiny cell, some undated rows."""
    cls = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") == 4, 7).otherwise(F.col("id") % 2)
    year = F.when(F.col("id") % 3 == 0, 2010).otherwise(2010 + F.col("id") % 5)
    return spark.range(6000).select(
        "id", cls.cast("int").alias("Default"), F.when(F.col("id") % 50 != 7, F.make_date(year, F.lit(6), F.lit(1))).alias("issue_date")
    )


@pytest.mark.parametrize("ranked", [10**9, 3])
def test_stratified_sample_is_the_k_smallest_hashes_per_cell(skewed, monkeypatch, ranked):
    monkeypatch.setattr(sampling, "_RANK_ROWS", ranked)
    cells = defaultdict(list)
    for r in skewed.where("issue_date is not null").collect():
        cells[r["Default"], r["issue_date"].year].append((md5("", r["id"]), r["id"]))
    want = sorted(i for rows in cells.values() for _, i in sorted(rows)[:25])
    found = stratified_sample(skewed, 25)
    assert found.columns == ["id", "Default"]
    assert sorted(r["id"] for r in found.collect()) == want


def test_exact_sample(skewed):
    want = sorted(i for _, i in sorted((md5("42|", i), i) for i in range(6000))[:1234])
    assert [r[0] for r in values(exact_sample(skewed, 1234), "id")] == sorted(want, key=lambda i: repr((i,)))
    assert exact_sample(skewed, 6000).count() == exact_sample(skewed, 10**6).count() == 6000
    assert exact_sample(skewed, 0).count() == 0
    assert values(exact_sample(skewed, 50, seed=1), "id") != values(exact_sample(skewed, 50, seed=2), "id")


def test_missing_ids_and_a_cut_between_rows_of_one_id_are_errors(spark):
    missing = spark.range(100).select(F.when(F.col("id") > 9, F.col("id")).alias("id"))
    with pytest.raises(Exception, match="missing values in id"):
        exact_sample(missing, 5).collect()
    repeated = spark.range(100).select((F.col("id") % 10).alias("id"))
    with pytest.raises(Exception, match="share the id"):
        exact_sample(repeated, 15).collect()
    assert exact_sample(repeated, 20).count() == 20


def test_holdout_takes_the_rounded_share_of_each_class(skewed):
    found = stratified_holdout(skewed, 0.15)
    sizes = {r["Default"]: (r["n"], r["h"]) for r in found.groupBy("Default").agg(F.count("*").alias("n"), F.count_if("is_holdout").alias("h")).collect()}
    assert all(h == int(n * 0.15 + 0.5) for n, h in sizes.values())
    assert found.columns == [*skewed.columns, "is_holdout"] and found.count() == 6000


def test_selection_ignores_partitioning(skewed):
    some = values(stratified_holdout(skewed).where("is_holdout"), "id")
    assert some == values(stratified_holdout(skewed.repartition(13, "Default")).where("is_holdout"), "id")


def test_null_stratum_is_a_stratum(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 40, F.col("id") % 2).alias("Default"))
    found = stratified_holdout(df, 0.5).where("is_holdout").groupBy("Default").count()
    assert values(found) == sorted([(0, 10), (1, 10), (None, 30)], key=repr)


def test_selection_does_not_shuffle_the_rows(skewed):
    plan = executed_plan(stratified_holdout(skewed))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_large_tables_are_not_broadcast(spark):
    df = spark.range(30).select("id", (F.col("id") % 7).alias("k"))
    side = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    with pytest.raises(bounded.TooManyRows):
        bounded.small_rows(side, 6)
    assert bounded.broadcast_if_small(side, 6) is side
    wide = spark.range(3).select(F.repeat(F.lit("x"), 8 << 20).alias("v"))
    with pytest.raises(bounded.TooManyRows):
        bounded.small_rows(wide)
    assert bounded.join_bounded(df, side, ["k"]).where("v = k * 10").count() == 30
