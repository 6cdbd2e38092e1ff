import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.ranges import fit_ranges, running_totals

PROBS = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.95, 1]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 5000
    columns = {
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.35, 7.0, rng.normal(size=n)),  # one value holds a third of the rows
        "few": rng.integers(0, 3, n).astype(float),
        "heavy": np.exp(rng.normal(0, 4, n)),
        "constant": np.full(n, 2.5),
    }
    rows = [
        tuple(None if rng.random() < 0.05 else float(v) for v in values) for values in zip(*columns.values())
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + "").withColumn("empty", F.lit(None).cast("double"))
    return df.repartition(7).cache()


@pytest.mark.parametrize("rows_per_range", [10**6, 300, 20])
def test_equal_to_numpy_whatever_the_ranges(data, rows_per_range):
    found = exact_quantiles(data, data.columns, PROBS, rows_per_range=rows_per_range)
    frame = data.toPandas()
    for c in data.columns:
        values = frame[c].dropna().to_numpy()
        if not len(values):
            assert found[c] == []
            continue
        np.testing.assert_array_equal(found[c], np.quantile(values, PROBS))


def test_a_column_of_one_value_beside_a_range_cut_again(spark):
    """A range of one value that many rows hold stays as it is while a range of another column is cut."""
    rng = np.random.default_rng(9)
    n = 5000
    columns = {
        "constant": np.full(n, 2.5),
        "flag": np.ones(n),
        "half": np.where(rng.random(n) < 0.5, 0.0, rng.random(n)),  # zeros and a few others share a range
        "tiny": np.where(rng.random(n) < 0.5, 0.0, 5e-324),  # halves of both are zero
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    found = exact_quantiles(df, df.columns, PROBS, rows_per_range=20)
    for c, values in columns.items():
        np.testing.assert_array_equal(found[c], np.quantile(values, PROBS))


def test_ranges_split_a_hot_column(data):
    ranges = fit_ranges(data, ["hot"], rows_per_range=100)
    sizes = {r["range_hot"]: r["count"] for r in ranges.ids(data).where("hot <> 7").groupBy("range_hot").count().collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 400


def test_no_columns():
    assert exact_quantiles(None, [], PROBS) == {}


@pytest.mark.parametrize("rows_per_range", [10**6, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_global_order(data, descending, rows_per_range):
    base = data.select(F.coalesce("few", F.lit(0.0)).alias("g"), F.col("smooth").alias("k"), F.lit(1).alias("one")).where("k is not null")
    ranges = fit_ranges(base, ["k"], rows_per_range=rows_per_range)
    points = ranges.ids(base).groupBy("g", "range_k", "k").agg(F.sum("one").alias("n"))
    totals = running_totals(points, ranges, by=["g"], range_col="range_k", key="k", sums=["n"], descending=descending)
    found = totals.toPandas().sort_values(["g", "k"], ascending=[True, not descending])
    for _, part in found.groupby("g"):
        assert (part["n_upto"].to_numpy() == part["n"].cumsum().to_numpy()).all()
        assert (part["n_total"] == part["n"].sum()).all()
        np.testing.assert_array_equal(part["next_key"].to_numpy()[:-1], part["k"].to_numpy()[1:])
        assert np.isnan(part["next_key"].to_numpy()[-1])


def test_ordering_runs_in_many_tasks(data):
    base = data.select(F.col("smooth").alias("k"), F.lit(1).alias("one")).where("k is not null")
    ranges = fit_ranges(base, ["k"], rows_per_range=100)
    points = ranges.ids(base).groupBy("range_k", "k").agg(F.sum("one").alias("n"))
    plan = executed_plan(running_totals(points, ranges, by=[], range_col="range_k", key="k", sums=["n"]))
    assert "hashpartitioning(range_k" in plan


def test_many_columns_with_odd_names(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(400, 200)) * 10.0 ** rng.integers(-8, 8, 200)
    names = [f"my col {i} `x` 'y'" for i in range(200)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"c{i} double" for i in range(200))).toDF(*names)
    found = exact_quantiles(df, names, [0.1, 0.5], rows_per_range=1)
    for i in (0, 57, 199):
        np.testing.assert_array_equal(found[names[i]], np.quantile(values[:, i], [0.1, 0.5]))
