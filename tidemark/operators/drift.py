"""Population stability index over all features in one pass, and the drift decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..settings import Settings
from .features import CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES, apply_scenario
from .quantiles import exact_quantiles, quoted, text_literal

# The features whose drift triggers a retrain, and the number of bins.
KEY_FEATURES = ("fico_n", "dti_n", "loan_to_income", "revenue", "loan_amnt")
BINS = 10


@dataclass(frozen=True)
class ReferenceBins:
    """Frozen bins of a reference population.

    ``edges`` are the inner bin borders; the outer bins are open. A feature without edges
    (too few rows, or fewer than three distinct deciles) has a PSI of 0 by definition.
    """

    edges: dict[str, tuple[float, ...]]

    def bin_of(self, feature: str) -> str:
        """SQL for the left-closed bin number of a column, null for a missing value."""
        name = quoted(feature)
        steps = " ".join(f"when {name} < {e!r}D then {i}" for i, e in enumerate(self.edges[feature]))
        return f"case when {name} is null then null {steps} else {len(self.edges[feature])} end"

    @property
    def usable(self) -> list[str]:
        return [f for f, e in self.edges.items() if e]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(feature, edges) rows: a few numbers per feature, to keep beside a store."""
        rows = [(f, list(e)) for f, e in self.edges.items()]
        return spark.createDataFrame(rows, "feature string, edges array<double>")

    @classmethod
    def from_frame(cls, df: DataFrame) -> ReferenceBins:
        return cls({r["feature"]: tuple(r["edges"]) for r in df.collect()})


def fit_reference(reference: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, bins: int = BINS) -> ReferenceBins:
    """Decile borders of the reference, duplicates removed."""
    numeric = list(numeric)
    found = exact_quantiles(reference, numeric, [i / bins for i in range(bins + 1)])
    small = {c for c in numeric if not found[c]}
    if enough := [c for c in numeric if found[c]]:
        sizes = reference.agg(*[F.count(F.col(quoted(c))).alias(c) for c in enough]).first()
        small.update(c for c in enough if sizes[c] < bins)
    edges = {}
    for c in numeric:
        distinct = sorted(set(found[c]))
        edges[c] = () if c in small or len(distinct) < 3 else tuple(distinct[1:-1])
    return ReferenceBins(edges)


def cells(df: DataFrame, bins: ReferenceBins, categorical: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per value: (by..., feature, bin, level), numeric missing values left out.

    For streams, which can count only one such table; ``count_cells`` is faster in batch.
    """
    parts = [f"{text_literal(f)}, {bins.bin_of(f)}, cast(null as string)" for f in bins.usable]
    parts += [f"{text_literal(f)}, cast(null as int), {_level(f)}" for f in categorical]
    stacked = f"stack({len(parts)}, {', '.join(parts)}) as (feature, bin, level)"
    return df.selectExpr(*by, stacked).where("bin is not null or level is not null")


def _level(feature: str) -> str:
    return f"coalesce(cast({quoted(feature)} as string), '{fx.MISSING_LEVEL}')"


def count_cells(
    sides: Mapping[str, DataFrame], bins: ReferenceBins, categorical: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., feature, bin, level, <side>...): how many values of each side fall in each cell.

    Bins and levels are counted apart. The two read different columns, and a bin is counted
    under one integer, which is much cheaper than under its feature's name. All counting
    starts before the shuffle, so a value that most rows share is no burden.
    """
    by, usable, categorical = list(by), bins.usable, list(categorical)

    def both(shape: str) -> DataFrame:
        marked = [
            df.selectExpr(*by, shape, *[f"{int(s == side)}L as {s}" for s in sides]) for side, df in sides.items()
        ]
        return reduce(DataFrame.unionByName, marked)

    totals = [F.sum(s).alias(s) for s in sides]
    tables = []
    if usable:
        stride = 1 + max(len(bins.edges[f]) for f in usable)
        codes = ", ".join(f"{i * stride} + {bins.bin_of(f)}" for i, f in enumerate(usable))
        counted = both(f"explode(array({codes})) as code").where("code is not null").groupBy(*by, "code").agg(*totals)
        names = F.array(*map(F.lit, usable))
        slot = F.floor(F.col("code") / stride).cast("int")
        tables.append(
            counted.select(
                *by,
                F.element_at(names, slot + 1).alias("feature"),
                (F.col("code") % stride).alias("bin"),
                F.lit(None).cast("string").alias("level"),
                *sides,
            )
        )
    if categorical:
        levels = ", ".join(f"{i}, {_level(f)}" for i, f in enumerate(categorical))
        counted = both(f"stack({len(categorical)}, {levels}) as (slot, level)").groupBy(*by, "slot", "level").agg(*totals)
        names = F.array(*map(F.lit, categorical))
        tables.append(
            counted.select(
                *by,
                F.element_at(names, F.col("slot") + 1).alias("feature"),
                F.lit(None).cast("int").alias("bin"),
                "level",
                *sides,
            )
        )
    if not tables:
        return next(iter(sides.values())).limit(0).select(
            *by,
            F.lit("").alias("feature"),
            F.lit(None).cast("int").alias("bin"),
            F.lit(None).cast("string").alias("level"),
            *[F.lit(0).cast("bigint").alias(s) for s in sides],
        )
    return reduce(DataFrame.unionByName, tables)


def psi_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, psi, n_ref, n_cur) from cell counts."""
    keys = [*by, "feature"]
    # Both uses of ``counts`` keep all of its columns, so they share one shuffle.
    totals = counts.groupBy(*keys).agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    term = fx.psi_term(F.col("ref") / F.col("n_ref"), F.col("cur") / F.col("n_cur"))
    both = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    if not by:
        totals = F.broadcast(totals)  # one row per feature; the counts grow with the levels
    return (
        counts.join(totals, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(both, term)), F.lit(0.0)).alias("psi"),
            F.max("n_ref").alias("n_ref"),
            F.max("n_cur").alias("n_cur"),
        )
    )


def feature_psi(
    reference: DataFrame,
    current: DataFrame,
    *,
    bins: ReferenceBins | None = None,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
) -> DataFrame:
    """(feature, kind, psi) for every feature, both sides counted in one job."""
    numeric, categorical = list(numeric), list(categorical)
    bins = bins or fit_reference(reference, numeric)
    counts = count_cells({"ref": reference, "cur": current}, bins, categorical)
    names = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    features = reference.sparkSession.createDataFrame(names, "feature string, kind string")
    found = psi_of_counts(counts).select("feature", "psi")
    return features.join(found, "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))


def population_stability_index(reference: DataFrame, current: DataFrame, column: str, *, categorical: bool) -> DataFrame:
    """One-row PSI of a single column; numeric columns are coerced first."""
    if categorical:
        return feature_psi(reference, current, numeric=(), categorical=(column,)).select("psi")
    ref = reference.select(fx.numeric(reference, column).alias(column))
    cur = current.select(fx.numeric(current, column).alias(column))
    return feature_psi(ref, cur, numeric=(column,), categorical=()).select("psi")


def prediction_psi(ref_scores: DataFrame, cur_scores: DataFrame, score: str = "score") -> DataFrame:
    return population_stability_index(ref_scores, cur_scores, score, categorical=False)


def drifted_features(psi: DataFrame, threshold: float, key_features: Sequence[str] = KEY_FEATURES) -> DataFrame:
    """PSI rows with the key flag and the strict threshold test, largest first."""
    return psi.select(
        "*",
        F.col("feature").isin(*key_features).alias("is_key"),
        (F.col("psi") > threshold).alias("drifted"),
    ).orderBy(F.desc("psi"), "feature")


@dataclass(frozen=True)
class DriftReport:
    """``features``: one row per feature. ``decision``: one row."""

    features: DataFrame
    decision: DataFrame


def evaluate_drift(
    reference: DataFrame,
    current: DataFrame,
    *,
    ref_scores: DataFrame | None = None,
    cur_scores: DataFrame | None = None,
    threshold: float | None = None,
    key_features: Sequence[str] = KEY_FEATURES,
    bins: ReferenceBins | None = None,
) -> DriftReport:
    """Feature PSI, prediction PSI when scores are given, and whether to retrain."""
    threshold = Settings().psi_threshold if threshold is None else threshold
    if unknown := [f for f in key_features if f not in FEATURE_COLUMNS]:
        raise KeyError(f"key features without a PSI: {unknown}")
    features = drifted_features(feature_psi(reference, current, bins=bins), threshold, key_features)
    fired = F.when(F.col("is_key") & F.col("drifted"), F.array_position(F.array(*map(F.lit, key_features)), F.col("feature")))
    positions = F.array_sort(F.collect_list(fired))  # at most one entry per key feature
    names = F.array(*map(F.lit, key_features))
    summary = features.agg(
        F.transform(positions, lambda i: F.element_at(names, i.cast("int"))).alias("drifted_features"),
        F.bool_or(F.col("is_key") & F.col("drifted")).alias("key_drift"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("feature_psi"),
    )
    sizes = {
        "n_reference": reference.agg(F.count(F.lit(1))).scalar(),
        "n_current": current.agg(F.count(F.lit(1))).scalar(),
    }
    score_psi = F.lit(None).cast("double")
    if ref_scores is not None and cur_scores is not None:
        score_psi = prediction_psi(ref_scores, cur_scores).scalar()
    decision = (
        summary.withColumns({**sizes, "prediction_psi": score_psi, "threshold": F.lit(threshold)})
        .withColumn("prediction_drift", F.coalesce(F.col("prediction_psi") > F.col("threshold"), F.lit(False)))
        .withColumn("drift_detected", F.col("key_drift") | F.col("prediction_drift"))
    )
    return DriftReport(features, decision)


# How a severity between 0 and 1 stretches the stress scenario.
SEVERITY_FICO, SEVERITY_DTI, SEVERITY_INCOME = -75.0, 0.75, -0.5


def severity_scenario(df: DataFrame, severity: Column) -> DataFrame:
    return apply_scenario(
        df,
        fico_shift=SEVERITY_FICO * severity,
        dti_scale=1 + SEVERITY_DTI * severity,
        income_scale=1 + SEVERITY_INCOME * severity,
    )


def scenario_grid_psi(reference: DataFrame, severities: Sequence[float], bins: ReferenceBins | None = None) -> DataFrame:
    """(severity, feature, psi): the reference against itself under each severity.

    Only the four features a scenario moves are counted per severity; the others do not
    change and are counted once.
    """
    moved = ["fico_n", "dti_n", "revenue", "loan_to_income"]
    bins = bins or fit_reference(reference)
    grid = F.explode(F.array(*[F.lit(float(s)) for s in severities]))
    moving = ReferenceBins({f: bins.edges[f] for f in moved})
    inputs = reference.select(*moved, "loan_amnt")
    stressed = severity_scenario(inputs.withColumn("severity", grid), F.col("severity"))
    still = feature_psi(
        reference,
        reference,
        bins=ReferenceBins({f: e for f, e in bins.edges.items() if f not in moved}),
        numeric=[f for f in NUMERIC_FEATURES if f not in moved],
    )
    none = F.lit(0).cast("bigint")
    base = count_cells({"ref": inputs}, moving, ()).select("*", grid.alias("severity"), none.alias("cur"))
    hit = count_cells({"cur": stressed}, moving, (), ["severity"]).withColumn("ref", none)
    counts = (
        base.unionByName(hit)
        .groupBy("severity", "feature", "bin", "level")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    names = reference.sparkSession.createDataFrame([(f,) for f in moved], "feature string")
    wanted = names.select("feature", grid.alias("severity"))
    found = wanted.join(psi_of_counts(counts, ["severity"]), ["severity", "feature"], "left")
    return found.select("severity", "feature", F.coalesce("psi", F.lit(0.0)).alias("psi")).unionByName(
        still.select(grid.alias("severity"), "feature", "psi")
    )
