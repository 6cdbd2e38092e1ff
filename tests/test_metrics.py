import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidemark import Settings, classification_metrics, ks_statistic, quality_gate, reliability_curve
from tidemark.operators.metrics import gate_passed, metrics_frame


def frame(spark, y, p, **extra):
    rows = list(zip(map(int, y), map(float, p), *extra.values()))
    return spark.createDataFrame(rows, ", ".join(["`Default` int", "score double", *[f"{c} string" for c in extra]]))


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    wins = sum((a > neg).sum() + 0.5 * (a == neg).sum() for a in pos)
    cuts = np.unique(p)[::-1]
    tpr, fpr = (np.array([(s >= c).mean() for c in cuts]) for s in (pos, neg))
    precision = np.array([y[p >= c].mean() for c in cuts])
    return {
        "roc_auc": wins / (len(pos) * len(neg)),
        "pr_auc": float(np.sum(np.diff(np.r_[0, tpr]) * precision)),
        "ks": max(0.0, np.max(tpr - fpr)),
        "brier": np.mean((p - y) ** 2),
        "base_rate": y.mean(),
        "n": len(y),
    }


@pytest.mark.parametrize("rows_per_range", [10**6, 60])
def test_metrics_equal_brute_force(spark, rows_per_range):
    rng = np.random.default_rng(2)
    p = np.where(rng.random(1500) < 0.35, 0.5, np.round(rng.random(1500), 3))  # one score holds a third
    y = (rng.random(1500) < p).astype(int)
    found = classification_metrics(frame(spark, y, p), rows_per_range=rows_per_range).first()
    for name, want in brute(y, p).items():
        assert found[name] == pytest.approx(want, rel=1e-10), name


def test_groups_are_measured_apart(spark):
    rng = np.random.default_rng(4)
    p, g = rng.random(900), rng.choice(["a", "b"], 900)
    y = (rng.random(900) < np.where(g == "a", p, 1 - p)).astype(int)
    found = classification_metrics(frame(spark, y, p, g=g.tolist()), by=["g"], rows_per_range=50).collect()
    for r in found:
        assert r["roc_auc"] == pytest.approx(brute(y[g == r["g"]], p[g == r["g"]])["roc_auc"])
    assert {r["g"]: r["roc_auc"] > 0.5 for r in found} == {"a": True, "b": False}


def test_perfect_and_inverted_ranking(spark):
    y, p = [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9]
    assert ks_statistic(frame(spark, y, p)).first()["ks"] == 1.0
    flipped = classification_metrics(frame(spark, y, [1 - v for v in p])).first()
    assert (flipped["ks"], flipped["roc_auc"]) == (0.0, 0.0)


def test_single_class_has_no_ranking(spark):
    row = classification_metrics(frame(spark, [1, 1], [0.2, 0.4])).first()
    assert row["roc_auc"] is None and row["ks"] is None and row["base_rate"] == 1.0


def test_metrics_stay_in_the_jvm_and_off_a_single_task(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.integers(0, 2, 500), rng.random(500))
    plan = executed_plan(classification_metrics(df, rows_per_range=20))
    assert "ArrowEval" not in plan and "hashpartitioning(range_score" in plan


def test_reliability_bins_are_closed_on_the_right(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(800), 1)
    y = rng.integers(0, 2, 800)
    edges = np.quantile(p, np.arange(11) / 10)
    which = np.searchsorted(edges[1:-1], p, side="left")
    rows = reliability_curve(frame(spark, y, p)).collect()
    assert [r["bin"] for r in rows] == sorted(set(which))
    for r in rows:
        inside = which == r["bin"]
        assert (r["n"], r["mean_predicted"], r["observed_rate"]) == (
            inside.sum(), pytest.approx(p[inside].mean()), pytest.approx(y[inside].mean()),
        )


def gate(spark, auc, **kwargs):
    row = metrics_frame(spark, {"test": dict(roc_auc=auc, pr_auc=0.3, ks=0.2, brier=0.15, base_rate=0.2, n=10)})
    lits = {k: F.lit(v) for k, v in kwargs.items()}
    found = quality_gate(row, settings=Settings(), **lits)
    return gate_passed(found).first()["passed"], {r["check"]: r for r in found.collect()}


@pytest.mark.parametrize("auc, passes", [(0.60, False), (0.67, True), (0.69, True), (None, False)])
def test_ranking_floor_blocks(spark, auc, passes):
    row = metrics_frame(spark, {"test": dict(roc_auc=auc or 0.0, pr_auc=0, ks=0, brier=0, base_rate=0, n=1)})
    found = quality_gate(row.withColumn("roc_auc", F.lit(auc).cast("double")))
    assert gate_passed(found).first()["passed"] is passes


def test_calibration_is_reported_without_blocking(spark):
    passed, checks = gate(spark, 0.70, brier_uncalibrated=0.15, brier_calibrated=0.18)
    assert passed and not checks["calibration_improves_brier"]["passed"]
    assert not checks["calibration_improves_brier"]["blocking"]
    assert checks["calibration_improves_brier"]["detail"] == "brier 0.15000 -> 0.18000"


@pytest.mark.parametrize("latency, passes", [(50.0, True), (300.0, False), (500.0, False)])
def test_latency_blocks_when_given(spark, latency, passes):
    passed, checks = gate(spark, 0.70, latency_p95_ms=latency)
    assert passed is passes and "latency_p95<300ms" in checks
    assert "latency_p95<300ms" not in gate(spark, 0.70)[1]


@pytest.mark.parametrize("column", ["score", "Default"])
def test_missing_scores_and_labels_are_errors(spark, column):
    df = spark.range(50).selectExpr("id / 50 as score", "id % 2 as Default")
    holes = df.withColumn(column, F.when(F.col("score") > 0.2, F.col(column)))
    for measure in (classification_metrics, reliability_curve):
        with pytest.raises(Exception, match=f"missing values in {column}"):
            measure(holes).collect()
