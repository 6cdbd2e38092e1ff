"""Drift per event-time window, continuously, against a frozen reference.

The stream's state is one counter per (window, feature, cell). A window is closed by the
watermark, once: its counters leave the state, and its PSI rows are written in a folder of
the window's own, so a replayed batch overwrites what it wrote before. Nothing else is kept:
files grow with the windows, not with the triggers, and no trigger reads earlier ones. Windows
still open are read from the state itself. Rows later than the watermark are dropped by Spark:
arrival may be disordered by at most that much.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import KEY_FEATURES, ReferenceBins, cells, psi_of_counts
from ..session import materialise
from ..sources.paths import child_paths, path_exists

_CELL = ["feature", "bin", "level"]
_PSI = "window_start timestamp, feature string, psi double, n_cur bigint"
_CLOSED = f"{_PSI}, is_key boolean, drifted boolean, window_id bigint"


@dataclass(frozen=True)
class FrozenReference:
    """Bins and cell counts of the reference, fixed before the stream starts."""

    bins: ReferenceBins
    counts: DataFrame
    categorical: tuple[str, ...]

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.bins.edges, *self.categorical)

    def key_features(self, named: Sequence[str] | None) -> tuple[str, ...]:
        """The features that may raise an alert: those named, else the batch decision's keys, else all."""
        if named is not None:
            if unknown := sorted(set(named) - set(self.features)):
                raise KeyError(f"key features without a PSI: {unknown}")
            return tuple(named)
        return tuple(f for f in KEY_FEATURES if f in self.features) or self.features

    @classmethod
    def fit(cls, reference: DataFrame, bins: ReferenceBins, categorical: Sequence[str]) -> FrozenReference:
        counts = cells(reference, bins, categorical).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("ref"))
        return cls(bins, materialise(counts, "reference-counts"), tuple(categorical))


def windowed_cells(rows: DataFrame, ref: FrozenReference, *, ts: str, width: str) -> DataFrame:
    """Counts per (window_start, cell); the same for a stream and a batch.

    Grouping is by the window itself: a start taken out of it would lose the event time, and
    with it the dropping of late rows and of finished counters.
    """
    windowed = rows.withColumn("window", F.window(F.col(ts), width))
    long = cells(windowed, ref.bins, ref.categorical, ["window"])
    counts = long.groupBy("window", *_CELL).agg(F.count(F.lit(1)).alias("cur"))
    return counts.select(F.col("window.start").alias("window_start"), *_CELL, "cur")


def windowed_psi(counts: DataFrame, ref: FrozenReference) -> DataFrame:
    """(window_start, feature, psi, n_cur) from current counts and the frozen reference."""
    # A window is compared with all reference cells, also those it has no rows in, and has a
    # row for every feature of the reference, also one that is missing all through the window.
    names = F.array(*[F.lit(f) for f in ref.features])
    features = counts.select("window_start").distinct().select("window_start", F.explode(names).alias("feature"))
    zero = F.lit(0).cast("bigint")
    expected = features.join(ref.counts, "feature").select("window_start", *_CELL, "ref", zero.alias("cur"))
    seen = counts.select("window_start", *_CELL, zero.alias("ref"), "cur")
    both = expected.unionByName(seen).groupBy("window_start", *_CELL).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    found = psi_of_counts(both, ["window_start"]).select("window_start", "feature", "psi", "n_cur")
    return features.join(found, ["window_start", "feature"], "left").select(
        "window_start", "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("n_cur", zero).alias("n_cur")
    )


def _closed_windows(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/windows"):
        return spark.createDataFrame([], _CLOSED)
    return spark.read.schema(_CLOSED).parquet(f"{path}/windows")


def open_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counters of the windows that the watermark has not closed, from the stream's state."""
    columns = ["window_start", *_CELL, "cur"]
    commits = f"{path}/checkpoint/commits"
    # Other files are the checksums some file systems keep beside them.
    if not path_exists(spark, commits) or not any(p.rsplit("/", 1)[1].isdigit() for p in child_paths(spark, commits)):
        return spark.createDataFrame([], "window_start timestamp, feature string, bin int, level string, cur bigint")
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    return state.select(F.col("key.window.start").alias("window_start"), *[f"key.{c}" for c in _CELL], "value.*").toDF(*columns)


def window_psi(spark: SparkSession, path: str, ref: FrozenReference) -> DataFrame:
    """(window_start, feature, psi, n_cur) of all windows, closed ones and those still open.

    While the stream runs, a window may be written as closed before the batch that closed it
    is committed; it counts as closed then.
    """
    closed = _closed_windows(spark, path).select("window_start", "feature", "psi", "n_cur")
    still_open = open_counts(spark, path).join(closed.select("window_start").distinct(), "window_start", "left_anti")
    return closed.unionByName(windowed_psi(still_open, ref))


def start_drift(
    rows: DataFrame,
    ref: FrozenReference,
    path: str,
    *,
    ts: str = "ts",
    width: str = "1 day",
    watermark: str = "1 day",
    threshold: float | None = None,
    key_features: Sequence[str] | None = None,
    score: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Write the PSI of every window under ``path`` once the watermark closes it.

    Given a ``threshold``, rows above it are marked as drifted; ``alerts`` gives the windows in
    which a key feature is. A window is judged once and whole: the few rows of one that has
    just begun would drift nearly always. ``score`` names a prediction column among the
    reference's features; its drift raises an alert beside that of the key features, as
    prediction drift does in the batch decision.
    """
    keys = dict.fromkeys([*ref.key_features(key_features), *([score] if score else [])])
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    counts = windowed_cells(timed, ref, ts=ts, width=width)

    def close(batch: DataFrame, batch_id: int) -> None:
        # Counters are read several times below: written, the state is only asked once.
        batch.write.mode("overwrite").parquet(f"{path}/closing")
        closing = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/closing")
        drifted = F.lit(None).cast("boolean") if threshold is None else F.col("psi") > threshold
        found = windowed_psi(closing, ref).select(
            "*",
            F.col("feature").isin(*keys).alias("is_key"),
            drifted.alias("drifted"),
            F.unix_micros("window_start").alias("window_id"),
        )
        # Only the folders of this batch's windows are replaced; without any nothing is written.
        writer = found.repartition("window_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("window_id").parquet(f"{path}/windows")

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(close)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """Closed windows in which a key feature drifted: (window_start, drifted_features, max_psi)."""
    fired = _closed_windows(spark, path).where("is_key and drifted")
    return fired.groupBy("window_start").agg(
        F.sort_array(F.collect_list("feature")).alias("drifted_features"), F.max("psi").alias("max_psi")
    )


def retrain_due(spark: SparkSession, path: str, handled_until=None) -> bool:
    """Whether a window fired that no earlier retrain has handled."""
    pending = alerts(spark, path)
    if handled_until is not None:
        pending = pending.where(F.col("window_start") > F.lit(handled_until))
    return not pending.isEmpty()
