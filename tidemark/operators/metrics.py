"""Ranking and calibration metrics of a score column, and the quality gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from .quantiles import exact_quantiles
from .ranges import ROWS_PER_RANGE, fit_ranges, running_totals

METRICS = ("roc_auc", "pr_auc", "ks", "brier", "base_rate", "n")
# Fixed value: slack of the calibration report.
BRIER_SLACK = 1e-6


def _present(name: str, kind: str) -> Column:
    """The column as numbers; a missing one fails the job instead of leaving some metrics."""
    value = F.col(f"`{name}`").cast(kind)
    return F.when(value.isNull(), F.raise_error(F.lit(f"missing values in {name}"))).otherwise(value)


def score_curve(
    df: DataFrame,
    *,
    score: str = "score",
    target: str = "Default",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per distinct score, highest first: counts of both classes, running and total.

    Equal scores collapse before anything is ordered, and the ordering runs range by range,
    so neither a score shared by many rows nor a very long curve ends up in one task.
    """
    by = list(by)
    rows = df.select(*by, _present(score, "double").alias("score"), _present(target, "bigint").alias("y"))
    ranges = fit_ranges(rows, ["score"], rows_per_range=rows_per_range)
    per_score = ranges.ids(rows).groupBy(*by, "range_score", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    return running_totals(
        per_score, ranges, by=by, range_col="range_score", key="score", sums=["pos", "neg"], descending=True
    ).drop("range_score")


def classification_metrics(
    df: DataFrame,
    *,
    score: str = "score",
    target: str = "Default",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """ROC-AUC, average precision, KS, Brier, base rate and row count, one row per group.

    AUC counts ties half, average precision is the step sum over distinct scores (not the
    trapezoid), KS is the largest lead of the true- over the false-positive rate. A metric
    that needs a class which does not occur is null. Missing scores and labels are an error.
    """
    curve = score_curve(df, score=score, target=target, by=by, rows_per_range=rows_per_range)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "pos_upto", "neg_upto"))
    all_pos, all_neg = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    s = F.col("score")
    rows = curve.select(
        *by,
        "pos",
        "neg",
        "pos_total",
        "neg_total",
        (neg * (tp - pos / 2)).alias("wins"),
        (pos * F.try_divide(tp, tp + fp)).alias("precision"),
        (F.try_divide(tp, all_pos) - F.try_divide(fp, all_neg)).alias("lead"),
        (pos * F.pow(1 - s, F.lit(2)) + neg * F.pow(s, F.lit(2))).alias("squares"),
    )
    p, n = F.max("pos_total"), F.max("neg_total")
    size = F.sum(F.col("pos") + F.col("neg"))
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum("wins"), (p * n).cast("double")).alias("roc_auc"),
        F.try_divide(F.sum("precision"), p.cast("double")).alias("pr_auc"),
        F.greatest(F.max("lead"), F.when((p > 0) & (n > 0), F.lit(0.0))).alias("ks"),
        (F.sum("squares") / size).alias("brier"),
        (p / size).alias("base_rate"),
        size.alias("n"),
    )


def ks_statistic(df: DataFrame, **names: str) -> DataFrame:
    return classification_metrics(df, **names).select("ks")


def reliability_curve(df: DataFrame, *, score: str = "score", target: str = "Default", n_bins: int = 10) -> DataFrame:
    """Mean predicted against observed rate in quantile bins.

    Bins are closed on the right, unlike PSI bins, and empty bins are absent. Missing scores
    and labels are an error.
    """
    rows = df.select(_present(score, "double").alias("score"), _present(target, "double").alias("y"))
    edges = exact_quantiles(rows, ["score"], [i / n_bins for i in range(n_bins + 1)])["score"]
    steps = " ".join(f"when score <= {e!r}D then {i}" for i, e in enumerate(edges[1:-1]))
    bin_of = F.expr(f"case {steps} else {n_bins - 1} end") if steps else F.lit(0)
    return (
        rows.groupBy(bin_of.alias("bin"))
        .agg(F.avg("score").alias("mean_predicted"), F.avg("y").alias("observed_rate"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
    )


@dataclass(frozen=True)
class Rule:
    """A row of the gate: it is asked when all its ``measures`` are given. ``{...}`` are settings."""

    check: str
    blocking: bool
    measures: tuple[str, ...]
    condition: str
    text: str


# Names, texts and conditions of the gate's rows.
GATE = (
    Rule("roc_auc>={auc_floor:.2f}", True, ("auc",), "auc >= {auc_floor!r}D", "test ROC-AUC = %.4f"),
    Rule("latency_p95<{latency:.0f}ms", True, ("p95",), "p95 < {latency!r}D", "p95 = %.1f ms"),
    Rule("calibration_improves_brier", False, ("before", "after"), "after <= before + {slack!r}D", "brier %.5f -> %.5f"),
)


def quality_gate(
    metrics: DataFrame,
    *,
    settings: Settings | None = None,
    brier_uncalibrated: Column | None = None,
    brier_calibrated: Column | None = None,
    latency_p95_ms: Column | None = None,
    rules: Sequence[Rule] = GATE,
) -> DataFrame:
    """(check, blocking, passed, detail), one row per rule that can be asked, for a one-row metrics table."""
    settings = settings or Settings()
    limits = {"auc_floor": float(settings.roc_auc_min), "latency": float(settings.latency_p95_ms), "slack": BRIER_SLACK}
    given = {"auc": F.col("roc_auc"), "p95": latency_p95_ms, "before": brier_uncalibrated, "after": brier_calibrated}
    given = {name: value for name, value in given.items() if value is not None}
    measured = metrics.select(*[value.cast("double").alias(name) for name, value in given.items()])
    asked = [
        F.struct(
            F.lit(rule.check.format(**limits)).alias("check"),
            F.lit(rule.blocking).alias("blocking"),
            F.expr(f"coalesce({rule.condition.format(**limits)}, false)").alias("passed"),
            F.format_string(rule.text, *rule.measures).alias("detail"),
        )
        for rule in rules
        if set(rule.measures) <= set(given)
    ]
    return measured.select(F.inline(F.array(*asked)))


def gate_passed(gate: DataFrame) -> DataFrame:
    """One row: whether every blocking check passed."""
    return gate.agg(F.coalesce(F.bool_and(F.when(F.col("blocking"), F.col("passed"))), F.lit(True)).alias("passed"))


def metrics_frame(spark: SparkSession, named: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Driver-held metrics of several splits as a table, in the given order."""
    rows = [(split, *[float(m[c]) for c in METRICS[:-1]], int(m["n"])) for split, m in named.items()]
    columns = ", ".join(f"{c} double" for c in METRICS[:-1])
    return spark.createDataFrame(rows, f"split string, {columns}, n long")
