"""Base-rate and cohort summaries over raw loan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import load_contract
from ..functions import columns as fx


def _target() -> Column:
    return F.col(f"`{load_contract().target}`")


def base_rate(df: DataFrame) -> DataFrame:
    y = _target()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(y.cast("bigint")).alias("n_default"),
        (F.count(F.lit(1)) - F.sum(y.cast("bigint"))).alias("n_repaid"),
        F.avg(y.cast("double")).alias("base_rate"),
    )


def cohort_rates(df: DataFrame, by: str = "purpose", min_count: int = 1, top: int | None = None) -> DataFrame:
    """Volume and default rate per cohort, riskiest first; ties are broken by cohort name."""
    out = (
        df.groupBy(F.col(f"`{by}`").alias("cohort"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(_target().cast("double")).alias("default_rate"))
        .where(F.col("n") >= int(min_count))
        .orderBy(F.desc("default_rate"), "cohort")
    )
    return out if top is None else out.limit(top)


def yearly_rates(df: DataFrame) -> DataFrame:
    """Volume and default rate per issue year, from the raw month; undated rows stay out."""
    year = F.year(fx.month_start(F.col(load_contract().time_column)))
    return (
        df.select(year.alias("issue_year"), _target().cast("double").alias("y"))
        .where("issue_year is not null")
        .groupBy("issue_year")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("default_rate"))
        .orderBy("issue_year")
    )


def cohort_report(df: DataFrame, top_purposes: int = 12) -> DataFrame:
    """Base rate, yearly, riskiest-purpose and home-ownership cohorts from a single scan.

    Grouping sets expand each input row to four narrow ones, which are summed before the
    shuffle. ``view`` tells the four tables apart; only cohort totals are ranked.
    """
    year = F.year(fx.month_start(F.col(load_contract().time_column)))
    keys = df.select(
        year.alias("issue_year"),
        F.col("purpose"),
        F.col("home_ownership_n").alias("home"),
        _target().cast("double").alias("y"),
    )
    sets = [[], [F.col("issue_year")], [F.col("purpose")], [F.col("home")]]
    grouped = keys.groupingSets(sets, "issue_year", "purpose", "home").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("default_rate")
    )
    # grouping_id has one bit per key, set when the key is not part of the grouping.
    view = (
        F.when(F.col("gid") == 0b111, "base_rate")
        .when(F.col("gid") == 0b011, "issue_year")
        .when(F.col("gid") == 0b101, "purpose")
        .otherwise("home_ownership_n")
    )
    cohort = (
        F.when(F.col("gid") == 0b011, F.col("issue_year").cast("string"))
        .when(F.col("gid") == 0b101, F.col("purpose"))
        .when(F.col("gid") == 0b110, F.col("home"))
    )
    out = grouped.select(view.alias("view"), cohort.alias("cohort"), "n", "default_rate")
    out = out.where((F.col("view") != "issue_year") | F.col("cohort").isNotNull())
    riskiest = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("default_rate"), "cohort"))
    return out.withColumn("place", riskiest).where(f"view <> 'purpose' or place <= {int(top_purposes)}").drop("place")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts and share of all rows, missing as its own level."""
    counts = df.groupBy(fx.category(F.col(f"`{column}`")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def distinct_values(df: DataFrame, columns: list[str], *, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact: columns become (column, value) pairs that are de-duplicated before the shuffle,
    so no task holds a whole column. ``approximate`` uses HyperLogLog in one pass instead.
    """
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("p")
    ).select("p.*")
    if approximate:
        return pairs.groupBy("column").agg(F.approx_count_distinct("value").alias("n_distinct"))
    return (
        pairs.groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count("value").alias("n_distinct"))
    )
