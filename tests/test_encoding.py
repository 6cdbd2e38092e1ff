import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidemark.operators import bounded, encoding
from tidemark.operators.encoding import FOLDS, fit_target_encoding


def fold(i, seed=42):
    return int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16) % FOLDS


def shrink(level: pd.Series, everyone: pd.Series) -> float:
    prior = everyone.mean()
    if not len(level):
        return prior
    m, n, var = level.mean(), len(level), everyone.var(ddof=0)
    weight = n * var / (n * var + m * (1 - m)) if n * var + m * (1 - m) else 0.0
    return weight * m + (1 - weight) * prior if n * var + m * (1 - m) else prior


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 900
    city = np.where(rng.random(n) < 0.35, "hot", rng.choice([f"c{i}" for i in range(40)], n))
    frame = pd.DataFrame({"id": range(n), "city": city, "kind": rng.choice(["x", "y", None], n), "Default": rng.integers(0, 2, n)})
    frame.loc[frame["city"] == "hot", "Default"] = (rng.random((frame["city"] == "hot").sum()) < 0.8).astype(int)
    frame.loc[0, "city"] = "only-once"
    return frame, spark.createDataFrame(frame, "id long, city string, kind string, `Default` int")


@pytest.mark.parametrize("limit", [100_000, 3])
def test_out_of_fold_values(rows, monkeypatch, limit):
    monkeypatch.setattr(bounded, "MAX_BROADCAST_ROWS", limit)
    monkeypatch.setattr(encoding, "small_rows", lambda df: bounded.small_rows(df, limit))
    frame, df = rows
    coded = fit_target_encoding(df, ["city", "kind"]).transform_train(df).toPandas().set_index("id")
    assert len(coded) == len(frame)
    frame = frame.assign(fold=frame["id"].map(fold), kind=frame["kind"].fillna("__NA__"))
    for i in (0, 1, 5, 77, 300, 899):
        row, rest = frame.loc[i], frame[frame["fold"] != frame.loc[i, "fold"]]
        for c in ("city", "kind"):
            want = shrink(rest.loc[rest[c] == row[c], "Default"], rest["Default"])
            assert coded.loc[i, f"{c}_te"] == pytest.approx(want, rel=1e-12), (i, c)


def test_full_fit_and_unseen_levels(spark, rows):
    frame, df = rows
    new = spark.createDataFrame([(0, "hot", None), (1, "nowhere", "x")], "id long, city string, kind string")
    found = fit_target_encoding(df, ["city", "kind"]).encoding.transform(new).toPandas().set_index("id")
    everyone = frame["Default"]
    assert found.loc[0, "city_te"] == pytest.approx(shrink(everyone[frame["city"] == "hot"], everyone))
    assert found.loc[0, "kind_te"] == pytest.approx(shrink(everyone[frame["kind"].isna()], everyone))
    assert found.loc[1, "city_te"] == pytest.approx(everyone.mean())


def test_own_label_does_not_reach_the_row(spark, rows):
    _, df = rows
    flipped = df.withColumn("Default", F.when(F.col("id") == 77, 1 - F.col("Default")).otherwise(F.col("Default")))
    a, b = (fit_target_encoding(d, ["city"]).transform_train(d).where("id = 77").first()["city_te"] for d in (df, flipped))
    assert a == b


def test_lookups_are_broadcast_while_small(rows):
    _, df = rows
    fitted = fit_target_encoding(df, ["city", "kind"])
    plan = executed_plan(fitted.encoding.transform(df))
    assert plan.count("BroadcastHashJoin") >= 2 and "hashpartitioning" not in plan


def test_empty_input_is_refused(rows):
    with pytest.raises(ValueError, match="no rows"):
        fit_target_encoding(rows[1].limit(0), ["city"])
