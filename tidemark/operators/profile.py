"""Per-column two-sample drift report and data summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..session import materialise
from .features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .quantiles import exact_quantiles, quoted, text_literal, unpivot_with_ranges
from .ranges import ROWS_PER_RANGE, fit_ranges, running_totals

# A column counts as drifted from this distance on, a table from this share on.
COLUMN_DISTANCE = 0.1
TABLE_SHARE = 0.5
_MIN_SIGMA = 0.001


def _wide_to_rows(wide: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row per column from a one-row table; ``fields`` maps an output name to a name pattern."""
    per_column = [
        F.struct(F.lit(c).alias("feature"), *[F.col(p.format(c)).alias(f) for f, p in fields.items()]) for c in columns
    ]
    return wide.select(F.inline(F.array(*per_column)))


def _side_facts(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], name: str) -> DataFrame:
    """(feature, <name>, sigma): missing shares and, of numbers, the deviation, by one aggregate."""
    columns = [*numeric, *categorical]
    missing = [F.avg(F.col(quoted(c)).isNull().cast("double")).alias(f"{i}_missing") for i, c in enumerate(columns)]
    sigma = [F.stddev_pop(quoted(c)).alias(f"{i}_sigma") for i, c in enumerate(numeric)]
    wide = df.agg(*missing, *sigma)
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{i}_missing").alias(name),
            (F.col(f"{i}_sigma") if i < len(numeric) else F.lit(None).cast("double")).alias("sigma"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def numeric_distances(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = NUMERIC_FEATURES,
    *,
    rows_per_range: int = ROWS_PER_RANGE,
    sigma: DataFrame | None = None,
) -> DataFrame:
    """(feature, ks, wasserstein): exact two-sample KS and Wasserstein-1 over sigma of the reference."""
    columns = list(columns)
    both = reference.select(*_doubles(columns), F.lit(1).alias("r"), F.lit(0).alias("c")).unionAll(
        current.select(*_doubles(columns), F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    ranges = fit_ranges(both, columns, rows_per_range=rows_per_range)
    per_value = (
        unpivot_with_ranges(ranges.ids(both), columns, ["r", "c"])
        .groupBy("feature", "rng", "x")
        .agg(F.sum("r").alias("ref"), F.sum("c").alias("cur"))
    )
    # Read three times below; shuffled once.
    per_value = materialise(per_value, "values-of-both-sides")
    curve = running_totals(per_value, ranges, by=["feature"], range_col="rng", key="x", sums=["ref", "cur"])
    gap = F.abs(
        F.try_divide(F.col("ref_upto"), F.col("ref_total")) - F.try_divide(F.col("cur_upto"), F.col("cur_total"))
    )
    area = gap * (F.col("next_key") - F.col("x"))
    distances = curve.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.coalesce(F.sum(area), F.lit(0.0)).alias("w1"), F.max("ref_total").alias("n_ref")
    )
    if sigma is None:
        sigma = _side_facts(reference, (), columns, "missing").select("feature", "sigma")
    scaled = F.col("w1") / F.greatest(F.col("sigma"), F.lit(_MIN_SIGMA))
    return sigma.join(distances, "feature", "left").select("feature", "ks", scaled.alias("wasserstein"))


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.col(quoted(c)).cast("double").alias(c) for c in columns]


def categorical_distances(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES
) -> DataFrame:
    """(feature, jensen_shannon): base-2 Jensen-Shannon distance, missing as its own level."""
    def levels(df: DataFrame, r: int, c: int) -> DataFrame:
        parts = ", ".join(f"{text_literal(x)}, coalesce(cast({quoted(x)} as string), '{fx.MISSING_LEVEL}')" for x in columns)
        return df.selectExpr(f"stack({len(columns)}, {parts}) as (feature, level)", f"{r} as r", f"{c} as c")

    counts = (
        levels(reference, 1, 0)
        .unionAll(levels(current, 0, 1))
        .groupBy("feature", "level")
        .agg(F.sum("r").alias("ref"), F.sum("c").alias("cur"))
    )
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    p, q = F.try_divide(F.col("ref"), F.col("n_ref")), F.try_divide(F.col("cur"), F.col("n_cur"))
    # One row per feature; the counts grow with the levels.
    shares = counts.join(F.broadcast(totals), "feature").select("feature", p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2

    def half(share: str) -> Column:
        return F.when(F.col(share) > 0, F.col(share) * F.log2(F.col(share) / m)).otherwise(F.lit(0.0))

    divergence = F.sum(half("p") + half("q")) / 2
    return shares.groupBy("feature").agg(F.sqrt(F.greatest(divergence, F.lit(0.0))).alias("jensen_shannon"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    *,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per column: distance and its kind, KS for numbers, missing shares, drift flag."""
    shape = "feature", "kind", "method", "distance", "ks"
    ref_facts = materialise(_side_facts(reference, categorical, numeric, "ref_missing"), "side-facts")
    cur_facts = _side_facts(current, categorical, numeric, "cur_missing").drop("sigma")
    sigma = ref_facts.where(F.col("feature").isin(*numeric)).select("feature", "sigma")
    numbers = numeric_distances(reference, current, numeric, rows_per_range=rows_per_range, sigma=sigma).select(
        "feature", F.lit("numeric").alias("kind"), F.lit("wasserstein").alias("method"),
        F.col("wasserstein").alias("distance"), "ks",
    )
    levels = categorical_distances(reference, current, categorical).select(
        "feature", F.lit("categorical").alias("kind"), F.lit("jensen_shannon").alias("method"),
        F.col("jensen_shannon").alias("distance"), F.lit(None).cast("double").alias("ks"),
    )
    return (
        numbers.select(*shape)
        .unionByName(levels.select(*shape))
        .join(ref_facts.drop("sigma"), "feature")
        .join(cur_facts, "feature")
        .withColumn("drifted", F.coalesce(F.col("distance") >= COLUMN_DISTANCE, F.lit(False)))
    )


def table_drift(report: DataFrame) -> DataFrame:
    """One row: drifted columns, their share, and whether the whole table counts as drifted."""
    drifted, total = F.count_if("drifted"), F.count(F.lit(1))
    return report.agg(
        total.alias("n_columns"),
        drifted.alias("n_drifted"),
        (drifted / total).alias("drift_share"),
        (drifted / total >= TABLE_SHARE).alias("table_drifted"),
    )


def column_profile(
    df: DataFrame,
    *,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    approximate_distinct: bool = False,
) -> DataFrame:
    """Count, missing, distinct, moments, quartiles and the most frequent value per column.

    Moments come from one narrow aggregate, quartiles from range selection. Distinct and most
    frequent values need every value once: equal values collapse before the shuffle and are
    spread by (column, value). ``approximate_distinct`` replaces that by HyperLogLog and
    leaves the most frequent value out.
    """
    numeric, categorical = list(numeric), list(categorical)
    columns = [*numeric, *categorical]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [F.count(c).alias(f"{c}__n") for c in columns]
    for c in numeric:
        v = F.col(c).cast("double")
        aggregates += [
            F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
            F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
        ]
    if approximate_distinct:
        aggregates += [F.approx_count_distinct(c).alias(f"{c}__d") for c in columns]
    wide = df.agg(*aggregates)
    nothing = F.lit(None).cast("double").alias("__none")
    wide = wide.select("*", nothing)
    moments = ("min", "max", "mean", "std")
    counted = {"rows": "rows", "n": "{}__n"}
    if approximate_distinct:
        counted["distinct"] = "{}__d"
    stats = _wide_to_rows(wide, numeric, counted | {m: "{}__" + m for m in moments}).unionByName(
        _wide_to_rows(wide, categorical, counted | {m: "__none" for m in moments})
    )
    stats = stats.withColumn("missing", F.col("rows") - F.col("n"))

    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    rows = [(c, *(q or [None] * 3)) for c, q in quartiles.items()]
    q = df.sparkSession.createDataFrame(rows, "feature string, q25 double, q50 double, q75 double")
    out = stats.join(F.broadcast(q), "feature", "left")
    if approximate_distinct:
        return out

    parts = [f"{text_literal(c)}, cast({quoted(c)} as double), cast(null as string)" for c in numeric]
    parts += [f"{text_literal(c)}, cast(null as double), cast({quoted(c)} as string)" for c in categorical]
    values = df.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) as (feature, x, level)")
    frequent = (
        values.where("x is not null or level is not null")
        .groupBy("feature", "x", "level")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("distinct"), F.max(F.struct("times", "x", "level")).alias("top"))
        .select(
            "feature", "distinct", F.col("top.times").alias("top_count"),
            F.col("top.x").alias("top_number"), F.col("top.level").alias("top_level"),
        )
    )
    return out.join(frequent, "feature", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
