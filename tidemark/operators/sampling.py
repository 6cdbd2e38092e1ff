"""Exact, repeatable row selection by hash order.

"The k rows of each stratum with the smallest hash" would need every row of a stratum
sorted in one task. Instead the k-th smallest hash is located first: a histogram of hash
prefixes finds the one prefix in which it falls, prefixes grow until few hashes share it, and
only those are ranked. A small fixed k needs no histogram: every task hands on its k smallest
hashes per stratum only, which one window over the narrow rows does by itself.
The selection itself is then a comparison with the cut, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from .bounded import join_bounded, small_table

# A bucket of this many hashes is ranked in one task; a larger one is told apart by more digits.
_RANK_ROWS = 100_000
_DIGITS = 2
# Ranks up to this are cut off inside the tasks, before the shuffle (the default of
# spark.sql.optimizer.windowGroupLimitThreshold).
_LIMITED_RANKS = 1000


def _smallest_cuts(rows: DataFrame, names: list[str], k: int) -> DataFrame:
    """Per stratum the last of its k smallest (h, row_id), and whether the next row has its id too."""
    order = Window.partitionBy(*names).orderBy("h", "row_id")
    ranked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    row = F.struct("h", "row_id")
    ends = ranked.groupBy(*names).agg(
        F.max(F.when(F.col("r") <= k, row)).alias("cut"), F.max(F.when(F.col("r") > k, row)).alias("following")
    )
    return ends.select(
        *names,
        F.col("cut.h").alias("cut_hash"),
        _told_apart(F.col("cut.row_id"), F.col("following.row_id")).alias("cut_id"),
    )


def _told_apart(mine: Column, following: Column) -> Column:
    """``mine``, unless the next row in order has the same id."""
    split = F.raise_error(F.concat(F.lit("rows share the id "), mine.cast("string")))
    return F.when(mine == following, split).otherwise(mine)


def hash_cuts(
    df: DataFrame, strata: dict[str, Column], size: Column | int, *, id_column: str, salt: object
) -> DataFrame:
    """Per stratum the hash and id of its last selected row.

    ``size`` is the number of rows to select: a number, or an expression that may use ``n``, the
    number of rows of the stratum. Strata with nothing to select are absent. Ids must be there and
    unique: a null id and a cut between rows of one id fail the job, since no hash order
    tells such rows apart.
    """
    names = list(strata) or ["__all"]
    keys = [c.alias(n) for n, c in strata.items()] or [F.lit(1).alias("__all")]
    row_id = F.col(f"`{id_column}`")
    known = F.when(row_id.isNull(), F.raise_error(F.lit(f"missing values in {id_column}"))).otherwise(row_id)
    rows = df.select(*keys, known.alias("row_id")).withColumn("h", fx.hash_order("row_id", salt))
    if isinstance(size, int):
        if size < _LIMITED_RANKS:
            return _smallest_cuts(rows, names, size).where("cut_hash is not null")
        size = F.lit(size)
    per_stratum = Window.partitionBy(*names)
    wanted, prefix = None, 0
    while True:
        prefix += _DIGITS
        rows = rows.withColumn("prefix", F.substring("h", 1, prefix))
        histogram = rows.groupBy(*names, "prefix").agg(F.count(F.lit(1)).alias("m"))
        ahead = F.coalesce(F.sum("m").over(per_stratum.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = histogram.select(*names, "prefix", "m", ahead.alias("ahead"), F.sum("m").over(per_stratum).alias("n"))
        if wanted is None:
            reached = reached.withColumn("k", F.least(size.cast("bigint"), F.col("n")))
        else:
            reached = join_bounded(reached, wanted, names)
        boundary = reached.where("ahead < k and k <= ahead + m").select(
            *names, "prefix", "m", (F.col("k") - F.col("ahead")).alias("k")
        )
        boundary = small_table(boundary)  # one row per stratum
        largest = boundary.agg(F.max("m")).first()[0] or 0
        rows = join_bounded(rows, boundary.select(*names, "prefix"), [*names, "prefix"])
        wanted = boundary.select(*names, "k")
        if largest <= _RANK_ROWS or prefix >= 32:
            break
    candidates = join_bounded(rows, wanted, names)
    order = Window.partitionBy(*names).orderBy("h", "row_id")
    ranked = candidates.withColumn("r", F.row_number().over(order)).withColumn("next_id", F.lead("row_id").over(order))
    cut_id = _told_apart(F.col("row_id"), F.col("next_id"))
    return ranked.where("r = k").select(*names, F.col("h").alias("cut_hash"), cut_id.alias("cut_id"))


def hash_select(
    df: DataFrame, strata: dict[str, Column], size: Column | int, *, id_column: str = "id", salt: object = ""
) -> tuple[DataFrame, Column]:
    """``df`` with its cuts joined, and the condition under which a row is selected."""
    keys = {f"__key_{n}": c for n, c in strata.items()} or {"__key___all": F.lit(1)}
    cuts = hash_cuts(df, strata, size, id_column=id_column, salt=salt)
    cuts = cuts.withColumnsRenamed({n: f"__key_{n}" for n in strata or ["__all"]})
    joined = join_bounded(df.withColumns(keys), cuts, list(keys), "left").drop(*keys)
    mine = F.struct(fx.hash_order(id_column, salt).alias("h"), F.col(f"`{id_column}`").alias("i"))
    cut = F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("i"))
    return joined, F.col("cut_hash").isNotNull() & (mine <= cut)


def stratified_sample(df: DataFrame, per_cell: int = 170, *, target: str = "Default", date: str = "issue_date") -> DataFrame:
    """At most ``per_cell`` rows of each (target, issue year), by hash of the id; undated rows stay out."""
    dated = df.where(F.col(date).isNotNull())
    strata = {"cls": F.col(f"`{target}`"), "yr": F.year(date)}
    rows, chosen = hash_select(dated, strata, per_cell)
    return rows.where(chosen).select(*[F.col(f"`{c}`") for c in df.columns if c != date])


def exact_sample(df: DataFrame, n: int, *, seed: int = 42, id_column: str = "id") -> DataFrame:
    """Exactly ``n`` rows, or all rows when there are no more than that; ids must be unique."""
    rows, chosen = hash_select(df, {}, n, id_column=id_column, salt=seed)
    return rows.where(chosen).select(*[F.col(f"`{c}`") for c in df.columns])


def stratified_holdout(
    df: DataFrame, fraction: float = 0.15, *, seed: int = 42, target: str = "Default", id_column: str = "id"
) -> DataFrame:
    """Add ``is_holdout``: the given fraction of each class, rounded, by salted hash."""
    size = F.round(F.col("n") * F.lit(fraction))
    rows, chosen = hash_select(df, {"cls": F.col(f"`{target}`")}, size, id_column=id_column, salt=seed)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], chosen.alias("is_holdout"))
