import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import FEATURE_COLUMNS, apply_scenario, drift_report, evaluate_drift, feature_psi, fit_reference
from tidemark import column_profile, population_stability_index, prediction_psi, scenario_grid_psi, table_drift
from tidemark.operators.drift import ReferenceBins, drifted_features
from tidemark.operators.profile import categorical_distances, numeric_distances


def one(spark, items, kind="double"):
    return spark.createDataFrame([(None if v is None else v,) for v in items], f"x {kind}")


def psi(ref, cur, categorical=False):
    return population_stability_index(ref, cur, "x", categorical=categorical).first()[0]


def brute_psi(ref, cur, bins=10):
    ref, cur = (np.array([v for v in s if v is not None and not np.isnan(v)]) for s in (ref, cur))
    if len(ref) < bins or not len(cur):
        return 0.0
    inner = np.unique(np.quantile(ref, np.arange(bins + 1) / bins))
    if len(inner) < 3:
        return 0.0
    total = 0.0
    for i in range(len(inner) - 1):
        low = -np.inf if i == 0 else inner[i]
        high = np.inf if i == len(inner) - 2 else inner[i + 1]
        r, c = (max(np.mean((s >= low) & (s < high)), 1e-6) for s in (ref, cur))
        total += (c - r) * np.log(c / r)
    return total


@pytest.fixture(scope="module")
def normal(spark):
    rng = np.random.default_rng(0)
    base, shifted = rng.normal(0, 1, 5000), rng.normal(2.5, 1, 5000)
    return one(spark, map(float, base)), one(spark, map(float, shifted)), brute_psi(base, shifted)


def test_identical_is_zero(normal):
    assert psi(normal[0], normal[0]) < 1e-6


def test_shift_is_found_and_equals_brute_force(normal):
    ref, cur, want = normal
    assert want > 0.2
    assert psi(ref, cur) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize(
    "ref, cur",
    [
        ([1.0] * 9, [5.0] * 50),  # fewer rows than bins
        ([1.0] * 500, [5.0] * 500),  # constant
        ([0.0] * 650 + [1.0] * 350, [1.0] * 100),  # two values, neither changing at a decile
        ([float(i) for i in range(100)], []),
        ([float(i) for i in range(100)], [None, float("nan")]),
        ([], [1.0]),
    ],
)
def test_undefined_is_zero(spark, ref, cur):
    assert brute_psi(ref, cur) == 0.0
    assert psi(one(spark, ref), one(spark, cur)) == 0.0


def test_ties_missing_and_unseen_ranges(spark):
    rng = np.random.default_rng(1)
    ref = [None if v < 2 else float(v) for v in rng.integers(0, 12, 800)]
    cur = [float("nan") if v == 3 else float(v) for v in rng.integers(-50, 6, 700)]
    assert psi(one(spark, ref), one(spark, cur)) == pytest.approx(brute_psi(ref, cur), rel=1e-12)


def test_categorical(spark):
    ref, cur = ["a"] * 800 + ["b"] * 200, ["a"] * 200 + ["b"] * 800
    want = 0.6 * np.log(4) * 2
    assert psi(one(spark, ref, "string"), one(spark, cur, "string"), True) == pytest.approx(want)
    assert psi(one(spark, ref, "string"), one(spark, [], "string"), True) == 0.0
    missing = psi(one(spark, ref, "string"), one(spark, ["a"] * 600 + ["b"] * 200 + [None] * 200, "string"), True)
    assert missing > 0.2


def test_predictions(spark):
    rng = np.random.default_rng(0)
    ref, cur = (spark.createDataFrame([(float(v),) for v in rng.uniform(a, b, 5000)], "score double") for a, b in ((0, 0.3), (0.4, 0.8)))
    assert prediction_psi(ref, cur).first()[0] > 0.2


def test_injected_drift_fires_and_baseline_does_not(features):
    train = features.where("split = 'train'").select(*FEATURE_COLUMNS)
    fired = evaluate_drift(train, apply_scenario(train)).decision.first()
    assert fired["drift_detected"] and "fico_n" in fired["drifted_features"] and fired["feature_psi"]["fico_n"] > 0.2
    assert fired["prediction_psi"] is None and not fired["prediction_drift"]
    calm = evaluate_drift(train, train).decision.first()
    assert not calm["drift_detected"] and calm["drifted_features"] == []
    assert calm["n_reference"] == calm["n_current"] == train.count()


def test_threshold_is_strict(spark):
    psi_rows = spark.createDataFrame([("fico_n", 0.2), ("dti_n", 0.2000001), ("title_len", 9.0)], "feature string, psi double")
    found = {r["feature"]: (r["is_key"], r["drifted"]) for r in drifted_features(psi_rows, 0.2).collect()}
    assert found == {"fico_n": (True, False), "dti_n": (True, True), "title_len": (False, True)}


def test_unknown_key_feature_is_an_error(features):
    with pytest.raises(KeyError, match="fcio"):
        evaluate_drift(features, features, key_features=("fcio_n",))


def test_prediction_drift_alone_fires(spark, features):
    train = features.where("split = 'train'")
    low, high = (spark.range(500).select((F.col("id") / 1000 + s).alias("score")) for s in (0.0, 0.4))
    found = evaluate_drift(train, train, ref_scores=low, cur_scores=high).decision.first()
    assert found["prediction_drift"] and found["drift_detected"] and not found["key_drift"]


def test_all_features_are_counted_in_one_shuffle_of_the_data(features):
    train, test = features.where("split = 'train'"), features.where("split = 'test'")
    bins = fit_reference(train)
    found = feature_psi(train, test, bins=bins)
    assert {r["feature"] for r in found.collect()} == set(FEATURE_COLUMNS)
    plan = executed_plan(found)
    final = plan[: plan.index("Initial Plan")]
    assert "ReusedExchange" in final and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert "PartitionFilters: [isnotnull(split" in plan


def test_bins_survive_storage(spark, features):
    bins = fit_reference(features, ["fico_n", "has_desc"])
    assert ReferenceBins.from_frame(bins.to_frame(spark)) == bins
    assert bins.edges["has_desc"] == () and bins.usable == ["fico_n"]


def test_severity_grid_equals_one_scenario_at_a_time(features):
    train = features.where("split = 'train'")
    bins = fit_reference(train)
    grid = scenario_grid_psi(train, [0.0, 0.8], bins).collect()
    assert len(grid) == 30
    stressed = apply_scenario(train, fico_shift=-75 * 0.8, dti_scale=1 + 0.75 * 0.8, income_scale=1 - 0.5 * 0.8)
    want = {r["feature"]: r["psi"] for r in feature_psi(train, stressed, bins=bins).collect()}
    for r in grid:
        assert r["psi"] == pytest.approx(want[r["feature"]] if r["severity"] else 0.0, abs=1e-9)


def w1_and_ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), grid, side="right") / len(s) for s in (a, b))
    return np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)), np.max(np.abs(fa - fb))


@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_numeric_distances(spark, rows_per_range):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 2, 900), np.round(rng.normal(1, 3, 700), 1)
    found = numeric_distances(one(spark, map(float, a)), one(spark, map(float, b)), ["x"], rows_per_range=rows_per_range).first()
    w1, ks = w1_and_ks(a, b)
    assert found["ks"] == pytest.approx(ks) and found["wasserstein"] == pytest.approx(w1 / a.std())


def test_categorical_distance(spark):
    ref, cur = one(spark, ["a"] * 3 + ["b"], "string"), one(spark, ["b", "c", None, "c"], "string")
    p, q = np.array([0.75, 0.25, 0, 0]), np.array([0, 0.25, 0.5, 0.25])
    m = (p + q) / 2
    want = np.sqrt(sum(s[s > 0] @ np.log2(s[s > 0] / m[s > 0]) for s in (p, q)) / 2)
    assert categorical_distances(ref, cur, ["x"]).first()["jensen_shannon"] == pytest.approx(want)
    assert categorical_distances(ref, ref, ["x"]).first()["jensen_shannon"] == pytest.approx(0.0)


def test_report_and_table_verdict(features):
    train, test = features.where("split = 'train'"), features.where("split = 'test'")
    report = drift_report(train, apply_scenario(test))
    rows = {r["feature"]: r for r in report.collect()}
    assert set(rows) == set(FEATURE_COLUMNS) and rows["fico_n"]["drifted"] and not rows["has_title"]["drifted"]
    verdict = table_drift(report).first()
    assert verdict["n_drifted"] == sum(r["drifted"] for r in rows.values())
    assert verdict["drift_share"] == verdict["n_drifted"] / 15


def test_profile_equals_pandas(features):
    train = features.where("split = 'train'")
    frame: pd.DataFrame = train.toPandas()
    for r in column_profile(train).collect():
        s = frame[r["feature"]].dropna()
        assert (r["rows"], r["n"], r["missing"]) == (len(frame), len(s), len(frame) - len(s))
        assert r["distinct"] == s.nunique() and r["top_count"] == s.value_counts().iloc[0]
        if r["top_level"] is None:
            np.testing.assert_allclose([r["min"], r["max"], r["mean"], r["std"]], [s.min(), s.max(), s.mean(), s.std()])
            np.testing.assert_allclose([r["q25"], r["q50"], r["q75"]], s.quantile([0.25, 0.5, 0.75]))
    rough = column_profile(train, approximate_distinct=True).collect()
    assert all(abs(r["distinct"] - frame[r["feature"]].nunique()) <= 0.2 * max(frame[r["feature"]].nunique(), 5) for r in rough)
    assert values(column_profile(train.limit(0), numeric=["fico_n"], categorical=["purpose"]), "feature", "n", "distinct") == [
        ("fico_n", 0, 0), ("purpose", 0, 0),
    ]
