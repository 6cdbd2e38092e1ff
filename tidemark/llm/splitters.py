"""Exact splitters of a keyed, weighted table by repeated histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Cells that one bracket is cut into per round.
FAN_OUT = 4096
#: Keys must span less than this, so that differences stay exact; wider ones are cut in two.
KEY_SPAN = 1 << 61


def splitters(rows: DataFrame, targets: DataFrame, group: str, keys: Sequence[str], weight: str, fan_out: int = FAN_OUT) -> DataFrame:
    """Where each target weight falls when the rows of a group stand in order of ``keys``.

    ``rows``: group, whole-number keys without nulls, weight >= 0. ``targets``: (``group``,
    ``target_id``, ``target`` bigint). Result: (``group``, ``target_id``, ``target``, keys,
    ``below``): the row of these keys holds the target, that is ``below <= target < below +
    weight`` with ``below`` the weight of all rows before it. Targets at or beyond the weight
    of the group have no row in the result.

    Every target has a bracket of keys. A round cuts all distinct brackets into cells, counts
    the exact weight of each cell with one pass over the rows (aggregated before the shuffle),
    and puts the bracket of each target around the one cell that holds it. When a bracket has
    come down to one value of a key, the next key splits the rows that tie there. Only cell
    sums are shuffled; rows stay where they are.
    """
    found = targets.withColumn("below", F.lit(0).cast("bigint"))
    fixed: list[str] = []
    for key in keys:
        found = _refine(rows, found, [group, *fixed], key, weight, fan_out)
        fixed.append(key)
    return found


def _refine(rows: DataFrame, found: DataFrame, fixed: list[str], key: str, weight: str, fan_out: int) -> DataFrame:
    """Add ``key`` to what is known of each target."""
    names = [f"__{c}" for c in fixed]

    def on(other: DataFrame) -> list:
        return [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(fixed, names)]

    places = found.select(*[F.col(c).alias(n) for c, n in zip(fixed, names)]).distinct()
    ranges = rows.join(places, on(places), "left_semi").groupBy(*fixed).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ranges = ranges.withColumnsRenamed(dict(zip(fixed, names)))
    state = materialise(found.join(ranges, on(ranges)).drop(*names), "brackets")
    while True:
        widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
        if widest is None or widest <= 0:
            return state.withColumn(key, F.col("lo")).drop("lo", "hi")
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(fan_out)).cast("bigint")
        brackets = state.select(*[F.col(c).alias(n) for c, n in zip(fixed, names)], "lo", "hi", "below").distinct()
        cell = F.floor((F.col(key) - F.col("lo")) / step).cast("bigint")
        inside = rows.join(brackets, [*on(brackets), F.col(key) >= F.col("lo"), F.col(key) <= F.col("hi")])
        # A bracket shrinks to the keys that are there, and so ends early when one is left.
        cells = inside.groupBy(*names, "lo", "below", cell.alias("cell")).agg(
            F.sum(weight).cast("bigint").alias("inside"), F.min(key).alias("new_lo"), F.max(key).alias("new_hi")
        )
        order = Window.partitionBy(*names, "lo").orderBy("cell")
        cells = cells.withColumn("start", F.col("below") + F.sum("inside").over(order) - F.col("inside"))
        cells = cells.withColumnRenamed("lo", "old_lo").drop("below")
        held = [F.col("lo") == F.col("old_lo"), F.col("start") <= F.col("target"), F.col("target") < F.col("start") + F.col("inside")]
        kept = [c for c in state.columns if c not in ("lo", "hi", "below")]
        moved = state.join(cells, [*on(cells), *held]).select(
            *kept, F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("start").alias("below")
        )
        state = materialise(moved, "brackets")
