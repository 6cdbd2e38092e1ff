"""Cross-fitted target encoding of categoricals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import columns as fx
from ..session import materialise
from .bounded import TooManyRows, small_rows
from .features import CATEGORICAL_FEATURES
from .quantiles import quoted

# Fixed value: folds of the cross-fitting.
FOLDS = 5
SUFFIX = "_te"


def fold_of(id_column: str = "id", seed: object = 42, folds: int = FOLDS) -> Column:
    """Fold from the salted hash of the id: the same whatever the partitioning."""
    return F.conv(F.substring(fx.hash_order(id_column, seed), 1, 8), 16, 10).cast("bigint") % folds


def shrunk_mean(n: Column, pos: Column, all_n: Column, all_pos: Column) -> Column:
    """Level mean pulled to the overall mean by empirical Bayes (Micci-Barreca 2001).

    With ``m`` the level mean and ``V`` the variance of the target, the weight of the level
    mean is nV / (nV + m(1-m)). A 0/1 target gives both variances from counts alone.
    """
    m, prior = F.try_divide(pos, n), F.try_divide(all_pos, all_n)
    spread = n * prior * (1 - prior)
    weight = F.try_divide(spread, spread + m * (1 - m))
    return F.coalesce(weight * m + (1 - weight) * prior, prior)


def fold_counts(
    df: DataFrame, columns: Sequence[str], *, target: str, id_column: str, seed: object
) -> DataFrame:
    """(feature, level, fold, n, pos): all categoricals in one pass, counted before the shuffle."""
    levels = ", ".join(f"{i}, coalesce(cast({quoted(c)} as string), '{fx.MISSING_LEVEL}')" for i, c in enumerate(columns))
    keyed = df.select(*[F.col(quoted(c)) for c in columns], fold_of(id_column, seed).alias("fold"), F.col(f"`{target}`").cast("bigint").alias("y"))
    counted = (
        keyed.selectExpr("fold", "y", f"stack({len(columns)}, {levels}) as (slot, level)")
        .groupBy("slot", "level", "fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    feature = F.element_at(F.array(*map(F.lit, columns)), F.col("slot") + 1)
    return counted.select(feature.alias("feature"), "level", "fold", "n", "pos")


@dataclass(frozen=True)
class TargetEncoding:
    """``levels``: (feature, level, value) of the full fit. ``prior``: the overall mean."""

    levels: DataFrame
    prior: float
    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add one encoded column per categorical; unseen levels get the overall mean."""
        return _encode(df, self.levels, self.columns, {}, F.lit(self.prior))


@dataclass(frozen=True)
class CrossFit:
    """The full fit for new rows, and out-of-fold values for the rows it was fitted on."""

    encoding: TargetEncoding
    fold_levels: DataFrame
    id_column: str
    seed: object

    def transform_train(self, df: DataFrame) -> DataFrame:
        folded = df.withColumn("__fold", fold_of(self.id_column, self.seed))
        fold = {"fold": F.col("__fold")}
        return _encode(folded, self.fold_levels, self.encoding.columns, fold, F.lit(self.encoding.prior)).drop("__fold")


def _encode(
    df: DataFrame, table: DataFrame, columns: Sequence[str], extra: dict[str, Column], unseen: Column
) -> DataFrame:
    """Look every categorical up in ``table``: by broadcast while that is small, else by a shuffle join."""
    keys = ["level", *extra]
    try:
        small = {c: [] for c in columns}
        for row in small_rows(table.select("feature", *keys, "value")):
            small[row["feature"]].append(tuple(row)[1:])
    except TooManyRows:
        small = None
    for c in columns:
        theirs = {k: f"__{c}_{k}" for k in (*keys, "value")}
        if small is None:
            mine = table.where(F.col("feature") == c).select(*theirs).withColumnsRenamed(theirs)
        else:
            schema = StructType([StructField(name, table.schema[k].dataType) for k, name in theirs.items()])
            mine = F.broadcast(table.sparkSession.createDataFrame(small[c], schema))
        here = {"level": fx.category(F.col(c)), **extra}
        on = [here[k] == F.col(theirs[k]) for k in keys]
        df = df.join(mine, on, "left").select(*df.columns, F.coalesce(theirs["value"], unseen).alias(f"{c}{SUFFIX}"))
    return df


def fit_target_encoding(
    df: DataFrame,
    columns: Sequence[str] = CATEGORICAL_FEATURES,
    *,
    target: str = "Default",
    id_column: str = "id",
    seed: object = 42,
) -> CrossFit:
    """Fit on ``df``; only the totals per fold come to the driver."""
    folds = materialise(fold_counts(df, columns, target=target, id_column=id_column, seed=seed), "fold-counts")
    per_fold = folds.where(F.col("feature") == columns[0]).groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    totals = {r["fold"]: (r["n"], r["pos"]) for r in per_fold.collect()}
    all_n, all_pos = (sum(t[i] for t in totals.values()) for i in (0, 1))
    if not all_n:
        raise ValueError("cannot fit an encoding on no rows")

    n, pos = F.col("n"), F.col("pos")
    full = folds.groupBy("feature", "level").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    levels = full.select("feature", "level", shrunk_mean(n, pos, F.lit(all_n), F.lit(all_pos)).alias("value"))

    # At most FOLDS rows per level; a row's own fold is taken out of level and overall counts.
    level = Window.partitionBy("feature", "level")
    in_fold = {i: F.create_map(*[x for f, t in totals.items() for x in (F.lit(f), F.lit(t[i]))])[F.col("fold")] for i in (0, 1)}
    rest_n, rest_pos = F.sum("n").over(level) - n, F.sum("pos").over(level) - pos
    fold_levels = folds.select(
        "feature",
        "level",
        "fold",
        shrunk_mean(rest_n, rest_pos, F.lit(all_n) - in_fold[0], F.lit(all_pos) - in_fold[1]).alias("value"),
    )
    return CrossFit(TargetEncoding(levels, all_pos / all_n, tuple(columns)), fold_levels, id_column, seed)
