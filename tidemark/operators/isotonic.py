"""Monotone regression of a 0/1 target on a score, without bringing its blocks to one place.

Pooling adjacent violators leaves a stack of blocks per range of scores. Stacks of neighbouring
ranges merge into that of both: only blocks at the seam can be pooled any further. Rounds of
merging stop as soon as all seams ascend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .bounded import TooManyRows, small_rows

# Stacks that one task merges in a round.
_FAN_IN = 8
# Pieces that rows of one range of the curve are dealt into where the curve is too large to broadcast.
_SALTS = 8
_STACK = "part bigint, low double, high double, total double, weight double"
_NAMES = ["part", "low", "high", "total", "weight"]


def pooled(points: Iterator[tuple[float, float, float, float]], stack: list[list[float]]) -> None:
    """Put (low, high, total, weight) in order of score on the stack; means on it ascend afterwards."""
    for low, high, total, weight in points:
        # A block with at least the mean of the one above is pooled with it.
        while stack and stack[-1][2] * weight >= total * stack[-1][3]:
            low, _, t, w = stack.pop()
            total, weight = total + t, weight + w
        stack.append([low, high, total, weight])


def _batch(part: int, stack: list[list[float]]) -> pa.RecordBatch:
    columns = np.array(stack, float).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([pa.array([part] * len(stack), pa.int64()), *map(pa.array, columns)], _NAMES)


def _seams_ascend(stacks: DataFrame) -> bool:
    ends = stacks.groupBy("part").agg(
        F.min_by(F.col("total") / F.col("weight"), "low").alias("first"), F.max_by(F.col("total") / F.col("weight"), "low").alias("last")
    )
    order = Window.orderBy("part")  # one row per range
    return ends.withColumn("before", F.lag("last").over(order)).where("before >= first").isEmpty()


def fit_isotonic(scored: DataFrame, score: str = "raw_score", y: str = "y") -> IsotonicCurve:
    """The curve of ``y`` over ``score``; rows where either is null do not count."""
    rows = scored.select(F.col(f"`{score}`").cast("double").alias("low"), F.col(f"`{y}`").cast("double").alias("y")).dropna()
    # Equal scores are one weighted point, which is what pooling makes of them.
    points = rows.groupBy("low").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    ranges = points.repartitionByRange("low").sortWithinPartitions("low")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list[float]] = []
        for batch in batches:
            low, total, weight = (batch.column(c).to_pylist() for c in ("low", "total", "weight"))
            pooled(zip(low, low, total, weight), stack)
        if stack:
            yield _batch(TaskContext.get().partitionId(), stack)

    def merge(table: pa.Table) -> pa.Table:
        stack: list[list[float]] = []
        pooled(zip(*[table.sort_by("low").column(c).to_pylist() for c in _NAMES[1:]]), stack)
        return pa.Table.from_batches([_batch(table.column("part")[0].as_py(), stack)])

    # Written, so that the ranges and their numbers are those of one run.
    stacks = materialise(ranges.mapInArrow(pool, _STACK), "isotonic")
    while not _seams_ascend(stacks):
        merged = stacks.withColumn("part", F.expr(f"part div {_FAN_IN}")).groupBy("part").applyInArrow(merge, _STACK)
        stacks = materialise(merged, "isotonic")
    return IsotonicCurve(stacks.select("part", "low", "high", (F.col("total") / F.col("weight")).alias("value")))


@dataclass(frozen=True)
class IsotonicCurve:
    """``blocks``: (part, low, high, value), ascending. Between blocks the curve is a straight line."""

    blocks: DataFrame

    def transform(self, df: DataFrame, score: str = "raw_score", out: str = "calibrated") -> DataFrame:
        """Add ``out``, the curve at ``score``; beyond its ends the curve is flat, without blocks it is null."""
        try:
            known = list(small_rows(self.blocks.select("low", "high", "value")))
        except TooManyRows:
            return self._transform_by_ranges(df, score, out)
        xs, ys = _corners(pd.DataFrame(known, columns=["low", "high", "value"]))
        shared = df.sparkSession.sparkContext.broadcast((xs, ys))

        def at(x: pd.Series) -> pd.Series:
            return pd.Series(_interpolated(x.to_numpy(float), *shared.value))

        at.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(at, "double")(F.col(f"`{score}`").cast("double")))

    def _transform_by_ranges(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """The same with the blocks left where they are: rows meet those of their range.

        A range also gets the block before and after it, so that lines across its ends are known.
        """
        ends = self.blocks.groupBy("part").agg(
            F.min_by(F.struct("low", "high", "value"), "low").alias("first"), F.max_by(F.struct("low", "high", "value"), "low").alias("last")
        )
        order = Window.orderBy("part")  # one row per range
        near = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
        extra = near.select("part", F.inline(F.array("before", "after"))).dropna()
        starts = sorted((r["first"]["low"], r["part"]) for r in ends.collect())  # one per range
        bounds, parts = np.array([s[0] for s in starts]), np.array([s[1] for s in starts])

        def range_of(x: pd.Series) -> pd.Series:
            return pd.Series(parts[np.maximum(np.searchsorted(bounds, x.fillna(bounds[0]).to_numpy(float), side="right") - 1, 0)])

        range_of.__annotations__ = {"x": pd.Series, "return": pd.Series}
        names = df.columns
        value = F.col(f"`{score}`").cast("double")
        rows = df.select(
            F.struct(*[f"`{c}`" for c in names]).alias("row"),
            value.alias("x"),
            F.pandas_udf(range_of, "bigint")(value).alias("part"),
            F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).alias("salt"),
        )
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")).alias("salt")
        curve = self.blocks.select("part", "low", "high", "value").unionByName(extra).select("*", salts)
        schema = rows.select("row").withColumn(out, F.lit(None).cast("double")).schema

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = _interpolated(left.column("x").to_pandas().to_numpy(float), *_corners(right.to_pandas()))
            return pa.table({"row": left.column("row"), out: pa.array(found, pa.float64(), from_pandas=True)})

        met = rows.groupBy("part", "salt").cogroup(curve.groupBy("part", "salt")).applyInArrow(meet, schema)
        return met.select(*[F.col("row")[c].alias(c) for c in names], out)

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsotonicCurve:
        return cls(spark.read.parquet(path))


def _corners(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    blocks = blocks.sort_values("low")
    xs = blocks[["low", "high"]].to_numpy(float).ravel()
    return xs, np.repeat(blocks["value"].to_numpy(float), 2)


def _interpolated(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    if not len(xs):
        return np.full(len(x), np.nan)
    return np.where(np.isnan(x), np.nan, np.interp(x, xs, ys))
