"""Ordered work over many tasks: value ranges and running totals across them.

Curves and distances need rows in global order, and a window without partitions would put
them all in one task. Here a column is cut into value ranges of similar size, each range is
ordered on its own, and what lies in the ranges before is added from a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 250_000
# Ranges of the smallest and the largest table. The upper end is what the sketch can tell apart.
MIN_RANGES = 16
MAX_RANGES = 16_384
# Rows looked at per range to place the split points. They only balance the ranges: whatever
# they are, every row lands in exactly one range and results stay exact.
ROWS_PER_SPLIT_POINT = 200
_SKETCH_K = 32_768  # rank error well below the width of one range
_MERGE_GROUPS = 256


@dataclass(frozen=True)
class Ranges:
    """Inner split points per column, ascending; none means a single range."""

    splits: dict[str, tuple[float, ...]]

    @property
    def many(self) -> bool:
        """Whether any column has several ranges. If not, none has two different finite values."""
        return any(self.splits.values())

    def ids(self, df: DataFrame, prefix: str = "range_") -> DataFrame:
        """Add the range number of each column; missing values have none."""
        cut = [c for c, s in self.splits.items() if s]
        whole = {f"{prefix}{c}": F.when(F.col(f"`{c}`").isNotNull(), 0) for c, s in self.splits.items() if not s}
        if whole:
            df = df.withColumns(whole)
        if not cut:
            return df
        inf = float("inf")
        located = Bucketizer(
            splitsArray=[[-inf, *self.splits[c], inf] for c in cut],
            inputCols=cut,
            outputCols=[f"{prefix}{c}" for c in cut],
            handleInvalid="keep",
        ).transform(df)
        return located.withColumns({f"{prefix}{c}": F.col(f"{prefix}{c}").cast("int") for c in cut})


def fit_ranges(
    df: DataFrame, columns: list[str], *, rows_per_range: int = ROWS_PER_RANGE, at_least: int = MIN_RANGES
) -> Ranges:
    """Cut double columns into ranges of about ``rows_per_range`` rows, ``at_least`` so many.

    Runs a row count and a quantile sketch that is merged in two steps, so that no task
    receives the sketches of all others.
    """
    rows = df.count()
    n_ranges = min(MAX_RANGES, max(at_least, -(-rows // rows_per_range)))
    seen = df.select(*[F.col(f"`{c}`") for c in columns])
    wanted = n_ranges * ROWS_PER_SPLIT_POINT
    if rows > 2 * wanted:
        seen = seen.sample(wanted / rows, seed=1)
    k = F.lit(_SKETCH_K)
    group = (F.spark_partition_id() % _MERGE_GROUPS).alias("g")
    parts = seen.groupBy(group).agg(*[F.kll_sketch_agg_double(F.col(f"`{c}`"), k).alias(c) for c in columns])
    whole = parts.agg(*[F.kll_merge_agg_double(F.col(f"`{c}`"), k).alias(c) for c in columns])
    at = F.expr(f"array({', '.join(f'{i / n_ranges!r}D' for i in range(1, n_ranges))})")
    points = whole.select(
        *[F.when(F.kll_sketch_get_n_double(F.col(f"`{c}`")) > 0, F.kll_sketch_get_quantile_double(F.col(f"`{c}`"), at)).alias(c) for c in columns]
    ).first()
    inf = float("inf")
    return Ranges({c: tuple(sorted({p for p in points[c] or () if -inf < p < inf})) for c in columns})


def running_totals(
    df: DataFrame,
    ranges: Ranges,
    *,
    by: list[str],
    range_col: str,
    key: str,
    sums: list[str],
    descending: bool = False,
) -> DataFrame:
    """Running and grand totals of ``sums`` in order of ``key`` within each ``by`` group.

    ``df`` has one row per (by, range, key), with the range numbers of ``ranges``. Adds
    ``<s>_upto`` (this row included), ``<s>_total`` and ``next_key`` (null on the last row of
    a group).
    """

    def order(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    inside = Window.partitionBy(*by, range_col)
    along = inside.orderBy(order(key))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    if not ranges.many:
        return df.select(
            *df.columns,
            *[F.sum(s).over(so_far).alias(f"{s}_upto") for s in sums],
            *[F.sum(s).over(inside).alias(f"{s}_total") for s in sums],
            F.lead(key).over(along).alias("next_key"),
        )

    # One row per range of a group from here to the join.
    edge = F.max(key) if descending else F.min(key)
    per_range = df.groupBy(*by, range_col).agg(*[F.sum(s).alias(s) for s in sums], edge.alias("edge"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    between = group.orderBy(order(range_col))
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"__{c}") for c in [*by, range_col]],
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        F.lead("edge").over(between).alias("next_edge"),
    )
    # Both sides are shuffled by (by, range), which the windows inside the ranges need anyway.
    joined = df.join(offsets, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, range_col]])
    return joined.select(
        *df.columns,
        *[(F.col(f"{s}_before") + F.sum(s).over(so_far)).alias(f"{s}_upto") for s in sums],
        *[f"{s}_total" for s in sums],
        F.coalesce(F.lead(key).over(along), "next_edge").alias("next_key"),
    )
