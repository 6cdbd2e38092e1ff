import glob
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import engineer_features, split_summary, time_split
from tidemark.operators.split import expanded_window, split_integrity
from tidemark.session import work_dir
from tidemark.sources.loans import VIEW_SETTINGS


def test_split_is_time_ordered_disjoint_and_complete(raw, features):
    rows = {r["split"]: r for r in split_summary(features).collect()}
    assert str(rows["train"]["date_max"]) <= "1998-12-31" < str(rows["valid"]["date_min"])
    assert str(rows["valid"]["date_max"]) <= "1999-12-31" < str(rows["test"]["date_min"])
    assert all(r["rows"] > 0 and 0 < r["default_rate"] < 1 for r in rows.values())
    whole = split_integrity(features, VIEW_SETTINGS).first()
    assert whole["total"] == raw.count() == sum(whole[s] for s in rows)
    assert whole["misplaced"] == whole["shared_ids"] == 0


def test_integrity_reports_shared_and_misplaced_rows(features):
    moved = features.where("split = 'train'").limit(5).withColumn("split", F.lit("test"))
    found = split_integrity(features.unionByName(moved), VIEW_SETTINGS).first()
    assert (found["misplaced"], found["shared_ids"]) == (5, 5)


def test_undated_row_is_an_error(raw):
    frame = engineer_features(raw)
    one = F.when(F.col("id") != frame.first()["id"], F.col("issue_date"))
    with pytest.raises(ValueError, match="1 row"):
        time_split(frame.withColumn("issue_date", one), VIEW_SETTINGS)


def test_empty_split_is_reported(features):
    row = split_summary(features.where("split <> 'valid'")).where("split = 'valid'").first()
    assert row["rows"] == 0 and math.isnan(row["default_rate"]) and row["date_min"] is None


def test_expanded_window_prunes_partitions(features):
    window = expanded_window(features)
    assert values(window.select("split").distinct()) == [("train",), ("valid",)]
    plan = executed_plan(window.select("fico_n"))
    assert "PartitionFilters: [split" in plan


def test_rows_only_in_one_equals_both_differences(spark):
    from tidemark.operators import split

    left = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "b"), (3, "c", "d"), (4, "e", "f")], "x int, y string, z string")
    right = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "d"), (4, "e", "g"), (5, None, None)], "x int, y string, z string")
    want = left.exceptAll(right).unionAll(right.exceptAll(left))
    assert values(split.rows_only_in_one(left, right)) == values(want)
    assert len(split.differing_buckets(left, right)) > 1
    assert split.rows_only_in_one(left, left.repartition(3)).isEmpty() and split.differing_buckets(left, left) == []
    assert split.rows_only_in_one(left, left.limit(0)).count() == 5
    # Nulls in other places, and a row more of those that are there.
    swapped = spark.createDataFrame([("a", None)], "y string, z string"), spark.createDataFrame([(None, "a")], "y string, z string")
    assert split.rows_only_in_one(*swapped).count() == 2
    assert split.rows_only_in_one(left, left.unionAll(left.limit(1))).count() == 1


def test_rows_that_mostly_differ_are_compared_by_one_shuffle(spark):
    """No copy of either side is written, and each row is moved once."""
    from tidemark.operators import split

    left = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, null, id % 7) as x", "'a' as t")
    right = left.withColumn("x", F.col("x") + F.when(F.col("id") % 2 == 0, 1).otherwise(0)).unionAll(left.where("id = 1"))
    written = lambda: set(glob.glob(f"{work_dir(spark)}/bucketed-*"))
    before = written()
    found = split.rows_only_in_one(left, right)
    assert 2 * len(split.differing_buckets(left, right)) > split.BUCKETS and written() == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # Even ids whose x is known stand on both sides, and the repeated row on one.
    assert found.count() == 2 * left.where("id % 2 = 0 and x is not null").count() + 1
    few = split.rows_only_in_one(left, left.where("id <> 5"))
    assert values(few) == [(5, 5, "a")] and written() != before
