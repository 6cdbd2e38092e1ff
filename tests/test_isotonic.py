import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidemark.operators import isotonic
from tidemark.operators.bounded import TooManyRows
from tidemark.operators.isotonic import IsotonicCurve, fit_isotonic


def plain(x, y):
    """Monotone means by the min-max formula over distinct scores."""
    points = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"])
    s, w = (np.concatenate(([0.0], np.cumsum(points[c].to_numpy(float)))) for c in ("sum", "count"))
    n = len(points)
    mean = lambda i, j: (s[j + 1] - s[i]) / (w[j + 1] - w[i])
    return {v: max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k, v in enumerate(points.index)}


def scores(spark, n, distinct, seed):
    x = F.floor(F.rand(seed) * distinct) / distinct
    df = spark.range(n).select(x.alias("raw_score"), (F.rand(seed + 1) < 0.2 + 0.5 * x).cast("int").alias("y"))
    rows = [(r["raw_score"], r["y"]) for r in df.collect()]
    return spark.createDataFrame(rows, "raw_score double, y int"), rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_curve_equals_the_min_max_formula(spark, parts):
    df, rows = scores(spark, 500, 120, 3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = fit_isotonic(df)
        got = {r["raw_score"]: r["calibrated"] for r in curve.transform(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(*zip(*rows))
    assert got == {x: pytest.approx(v, abs=1e-12) for x, v in want.items()}


def test_a_falling_target_is_one_block_over_all_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("id / 1000D as raw_score", "int(id < 300) as y")
        blocks = fit_isotonic(df).blocks.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(b["low"], b["high"], b["value"]) for b in blocks] == [(0.0, 0.999, 0.3)]


def test_between_blocks_the_curve_is_straight_and_flat_beyond(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1)], "raw_score double, y int")
    at = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.9,), (None,)], "raw_score double")
    found = fit_isotonic(df).transform(at)
    assert values(found) == [(0.0, 0.0), (0.3, 0.0), (0.5, pytest.approx(0.5)), (0.9, 1.0), (None, None)]


def test_curves_too_large_to_broadcast_meet_rows_by_range(spark, monkeypatch):
    df, _ = scores(spark, 3000, 900, 5)
    curve = fit_isotonic(df)
    ranges = IsotonicCurve(curve.blocks.withColumn("part", F.floor(F.col("low") * 7).cast("bigint")))
    at = spark.range(500).select("id", (F.rand(9) * 1.2 - 0.1).alias("raw_score"), F.lit("x").alias("part"))
    at = at.unionByName(spark.createDataFrame([(1000, None, "y")], "id bigint, raw_score double, part string"))
    want = {r["id"]: r["calibrated"] for r in curve.transform(at).collect()}

    def never(*_):
        raise TooManyRows

    monkeypatch.setattr(isotonic, "small_rows", never)
    found = ranges.transform(at)
    assert found.columns == ["id", "raw_score", "part", "calibrated"]
    assert {r["id"]: r["calibrated"] for r in found.collect()} == {i: v if v is None else pytest.approx(v) for i, v in want.items()}


def test_a_million_distinct_scores(spark):
    n = 1_000_000
    df = spark.range(n).select((F.col("id") / n).alias("raw_score"), (F.rand(1) < F.col("id") / n).cast("int").alias("y"))
    curve = fit_isotonic(df)
    blocks = curve.blocks.orderBy("low").toPandas()
    assert 10 < len(blocks) < 5000  # what is kept grows with the cube root of the scores
    assert (np.diff(blocks["value"]) > 0).all() and (blocks["low"].to_numpy()[1:] > blocks["high"].to_numpy()[:-1]).all()
    middle = (blocks["low"] + blocks["high"]) / 2
    assert np.abs(middle - blocks["value"])[5:-5].max() < 0.05


def test_no_rows_and_nulls(spark):
    empty = spark.createDataFrame([], "raw_score double, y int")
    assert fit_isotonic(empty).transform(spark.createDataFrame([(0.5,)], "raw_score double")).first()["calibrated"] is None
    some = spark.createDataFrame([(0.5, 1), (None, 0), (0.1, None)], "raw_score double, y int")
    assert [tuple(r) for r in fit_isotonic(some).blocks.select("low", "high", "value").collect()] == [(0.5, 0.5, 1.0)]
