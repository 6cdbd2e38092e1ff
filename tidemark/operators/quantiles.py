"""Exact quantiles of several columns without bringing a long column together.

The columns are cut into ranges and a histogram says in which range each wanted order
statistic falls. A range that still holds many values is cut again, evenly between its
smallest and largest value, until few are left; only those are counted one by one and
ordered. The steps are the same whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ROWS_PER_RANGE, fit_ranges

# Ranges of the first cut and cells of every later one.
_RANGES = 1024
_BRACKET = "column int, rank bigint, lo double, hi double, below bigint, inside bigint"


def quoted(name: str) -> str:
    """A column name for use inside SQL text."""
    return "`" + name.replace("`", "``") + "`"


def unpivot_with_ranges(df: DataFrame, columns: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """(feature, rng, x) rows for the non-missing values; ``extra`` columns come along."""
    parts = ", ".join(f"{text_literal(c)}, {quoted(f'range_{c}')}, cast({quoted(c)} as double)" for c in columns)
    long = df.selectExpr(*extra, f"stack({len(columns)}, {parts}) as (feature, rng, x)")
    return long.where("x is not null")


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *, rows_per_range: int = ROWS_PER_RANGE
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; an empty list for a column without values.

    What comes to the driver is one bracket per wanted order statistic, at most two of which belong to a
    column and probability. Missing values must be null, not NaN.
    """
    columns = list(columns)
    if not columns:
        return {}
    doubles = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = doubles.columns
    located = fit_ranges(doubles, names, rows_per_range=rows_per_range, at_least=_RANGES).ids(doubles)
    parts = ", ".join(f"{i}, range_{c}, {c}" for i, c in enumerate(names))
    long = located.selectExpr(f"stack({len(names)}, {parts}) as (column, cell, x)").where("x is not null")
    counts = long.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = Window.partitionBy("column").orderBy("cell")
    counts = counts.withColumns({
        "below": F.sum("inside").over(order) - F.col("inside"),
        "size": F.sum("inside").over(Window.partitionBy("column")),
    })
    position = (F.col("size") - 1) * F.col("p")
    wanted = F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position))))
    each = counts.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    hit = each.select("*", wanted.alias("rank")).where("below <= rank and rank < below + inside")
    found = {tuple(r) for r in hit.select("column", "rank", "lo", "hi", "below", "inside", "size").collect()}
    sizes = {c: size for c, *_, size in found}
    brackets = {b[:-1] for b in found}
    values = doubles.selectExpr(f"stack({len(names)}, {', '.join(f'{i}, {c}' for i, c in enumerate(names))}) as (column, x)")
    # Brackets of a single value are settled, however many rows hold it.
    while wide := {b for b in brackets if b[2] < b[3] and b[5] > rows_per_range}:
        cut = set(_cut_again(values, wide))
        if cut == wide:  # infinite ends cannot be cut, nor ends too close for a double between them
            break
        brackets = brackets - wide | cut
    at = {(c, rank): lo for c, rank, lo, hi, _, _ in brackets if lo == hi}
    at |= _pick(values, [b for b in brackets if b[2] < b[3]])
    return {
        c: [_interpolate(at, i, sizes[i], p) for p in probabilities] if i in sizes else [] for i, c in enumerate(columns)
    }


def _inside(values: DataFrame, brackets: Iterable[tuple]) -> DataFrame:
    """The values in each distinct bracket; ``found`` is one row per wanted order statistic."""
    distinct = sorted({(c, lo, hi, below) for c, _, lo, hi, below, _ in brackets})
    table = values.sparkSession.createDataFrame(distinct, "bracket_column int, lo double, hi double, below bigint")
    on = (F.col("column") == F.col("bracket_column")) & F.col("x").between(F.col("lo"), F.col("hi"))
    return values.join(F.broadcast(table), on).drop("bracket_column")  # a few rows per column


def _cut_again(values: DataFrame, brackets: set[tuple]) -> list[tuple]:
    # Halves before the difference, so that it cannot overflow; those of the smallest doubles may be equal.
    share = F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * _RANGES), F.lit(_RANGES - 1))
    counts = _inside(values, brackets).groupBy("column", "lo", "hi", "below", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("inside"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi")
    )
    order = Window.partitionBy("column", "lo", "hi").orderBy("cell")
    counts = counts.withColumn("start", F.col("below") + F.sum("inside").over(order) - F.col("inside"))
    wanted = values.sparkSession.createDataFrame(sorted(brackets), _BRACKET).drop("below", "inside")
    hit = counts.join(F.broadcast(wanted), ["column", "lo", "hi"]).where("start <= rank and rank < start + inside")
    return [tuple(r) for r in hit.select("column", "rank", "new_lo", "new_hi", "start", "inside").collect()]


def _pick(values: DataFrame, brackets: list[tuple]) -> dict[tuple[int, int], float]:
    if not brackets:
        return {}
    per_value = _inside(values, brackets).groupBy("column", "lo", "hi", "below", "x").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column", "lo", "hi").orderBy("x")
    per_value = per_value.withColumn("start", F.col("below") + F.sum("n").over(order) - F.col("n"))
    wanted = values.sparkSession.createDataFrame(sorted(brackets), _BRACKET).drop("below", "inside")
    hit = per_value.join(F.broadcast(wanted), ["column", "lo", "hi"]).where("start <= rank and rank < start + n")
    return {(r["column"], r["rank"]): r["x"] for r in hit.collect()}


def _interpolate(at: dict[tuple[int, int], float], column: int, size: int, p: float) -> float:
    position = (size - 1) * p
    low, fraction = math.floor(position), position - math.floor(position)
    a, b = at[column, low], at[column, math.ceil(position)]
    if a == b:
        return a
    # From the nearer end, which keeps the result between the two.
    return a + (b - a) * fraction if fraction < 0.5 else b - (b - a) * (1 - fraction)
