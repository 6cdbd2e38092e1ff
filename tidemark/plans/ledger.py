"""Model versions and their stages as an append-only log of commits.

State is a fold over events ordered by ``seq``. A commit is one file, named by its number and
created only if no file of that number is there: of writers that have seen the same state one
succeeds, the others look again and decide anew. Every event says how many its commit holds, so
a reader passes over a commit that is still being written.
"""

from __future__ import annotations

import json
import os
import re
import time
from datetime import UTC, datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import Settings
from ..sources.paths import child_paths, path_exists

STAGE_NONE, STAGING, PRODUCTION, ARCHIVED = "None", "Staging", "Production", "Archived"
EVENT_SCHEMA = (
    "seq bigint, model_name string, version int, event string, stage string, metrics map<string,double>, "
    "params map<string,string>, tags map<string,string>, model_path string, input_schema string, ts timestamp"
)
_COMMIT_SCHEMA = f"{EVENT_SCHEMA.removeprefix('seq bigint, ')}, commit bigint, place int, size int"
_COMMIT = re.compile(r"commit-(\d{12})\.json$")
# Seconds that a commit may take to be written before others pass over it, and tries of a writer.
_PATIENCE = 20.0
_TRIES = 100


@dataclass(frozen=True)
class Event:
    version: int
    event: str
    stage: str | None = None
    metrics: Mapping[str, float] = field(default_factory=dict)
    params: Mapping[str, str] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)
    model_path: str | None = None
    input_schema: str | None = None


def _log(spark: SparkSession, settings: Settings) -> DataFrame:
    written = spark.read.schema(_COMMIT_SCHEMA).option("mode", "DROPMALFORMED").json(settings.ledger_dir)
    # All events of a commit are in one file, a few rows.
    whole = F.count(F.lit(1)).over(Window.partitionBy("commit")) == F.col("size")
    return written.withColumn("whole", whole).where("whole").drop("whole")


def events(spark: SparkSession, settings: Settings) -> DataFrame:
    """All events of this model; empty only when nothing was ever written."""
    if not path_exists(spark, settings.ledger_dir):
        return spark.createDataFrame([], EVENT_SCHEMA)
    own = _log(spark, settings).where(F.col("model_name") == settings.model_name)
    order = Window.partitionBy("model_name").orderBy("commit", "place")
    return own.select(F.row_number().over(order).cast("bigint").alias("seq"), *own.drop("commit", "place", "size").columns)


def _last_commit(spark: SparkSession, settings: Settings) -> int:
    if not path_exists(spark, settings.ledger_dir):
        return 0
    found = [_COMMIT.search(path) for path in child_paths(spark, settings.ledger_dir)]
    return max((int(m[1]) for m in found if m), default=0)


def _settled(spark: SparkSession, settings: Settings, number: int) -> None:
    """Wait until commit ``number`` is whole, or for so long that its writer must be gone."""
    until = time.monotonic() + _PATIENCE
    while number and _log(spark, settings).where(F.col("commit") == number).isEmpty():
        if time.monotonic() > until:
            return
        time.sleep(0.2)


def _create(spark: SparkSession, settings: Settings, number: int, new: Sequence[Event]) -> bool:
    """Write commit ``number``; False when there is one already."""
    shared = {"model_name": settings.model_name, "ts": datetime.now(UTC).isoformat(), "commit": number, "size": len(new)}
    rows = [{**asdict(e), **shared, "place": i} for i, e in enumerate(new)]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{settings.ledger_dir}/commit-{number:012d}.json")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    if files.getUri().getScheme() == "file":
        # Hadoop looks for a local file before it creates one, and another writer may do so in between.
        target = path.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            with open(target, "xb") as out:
                out.write(data)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(path, False)  # fails if the file is there
    except Py4JJavaError as error:
        if files.exists(path):
            return False
        raise error
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return True


def commit(spark: SparkSession, settings: Settings, decide: Callable[[DataFrame], Sequence[Event]]) -> list[Event]:
    """Write the events that ``decide`` makes of the log, as one change.

    Whoever else commits meanwhile is seen: then ``decide`` is asked again, with the new log.
    """
    for _ in range(_TRIES):
        last = _last_commit(spark, settings)
        _settled(spark, settings, last)
        new = list(decide(events(spark, settings)))
        if not new or _create(spark, settings, last + 1, new):
            return new
    raise RuntimeError(f"the ledger changed {_TRIES} times while writing to it")


def append(spark: SparkSession, settings: Settings, new: Sequence[Event]) -> None:
    commit(spark, settings, lambda _: new)


def _latest(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)


def stages(log: DataFrame) -> DataFrame:
    """(version, stage, model_path): the fold that decides what is served."""
    state = log.groupBy("version").agg(_latest("stage"), _latest("model_path"))
    return state.withColumn("stage", F.coalesce("stage", F.lit(STAGE_NONE)))


def versions(log: DataFrame) -> DataFrame:
    """One row per version: current stage, and everything said about it, later words winning."""
    state = stages(log).join(log.groupBy("version").agg(_latest("input_schema"), F.min("ts").alias("created")), "version")
    for name in ("metrics", "params", "tags"):
        entries = log.select("version", "seq", F.explode(name))
        last = entries.groupBy("version", "key").agg(F.max_by("value", "seq").alias("value"))
        merged = last.groupBy("version").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name)
        )
        state = state.join(merged, "version", "left")
    return state


def latest_version(log: DataFrame) -> DataFrame:
    """The highest version as a number ("10" is after "9"), at most one row."""
    return stages(log).orderBy(F.desc("version")).limit(1)


def current_production(log: DataFrame) -> DataFrame:
    """The version in Production, at most one row."""
    return stages(log).where(F.col("stage") == PRODUCTION).orderBy(F.desc("version")).limit(1)


def served_version(log: DataFrame, prefer_production: bool = True) -> DataFrame:
    """Production when there is one and it is preferred, else the latest version."""
    rank = F.when((F.col("stage") == PRODUCTION) & F.lit(prefer_production), 1).otherwise(0)
    return stages(log).orderBy(F.desc(rank), F.desc("version")).limit(1)


def register(spark: SparkSession, settings: Settings, event_of_version: Callable[[int], Event]) -> int:
    """Write the event ``event_of_version(n)`` for the next version ``n``, which no other writer gets."""

    def decide(log: DataFrame) -> list[Event]:
        return [event_of_version((log.agg(F.max("version")).first()[0] or 0) + 1)]

    return commit(spark, settings, decide)[0].version


def promotion_events(state: Sequence[Row], version: int, roc_auc: float, archive_existing: bool = True) -> list[Event]:
    """Events that put ``version`` into Production, the committing one last.

    Tags come first. A version already in Production keeps serving without a Staging hop.
    """
    stage = next(r["stage"] for r in state if r["version"] == version)
    out = [Event(version, "tagged", tags={"promoted": "true", "test_roc_auc": f"{roc_auc:.4f}"})]
    if stage != PRODUCTION:
        out.append(Event(version, "stage", stage=STAGING))
    if archive_existing:
        out += [Event(r["version"], "stage", stage=ARCHIVED) for r in state if r["stage"] == PRODUCTION and r["version"] != version]
    out.append(Event(version, "stage", stage=PRODUCTION))
    return out


# The metrics a served model is described by.
INFO_METRICS = ("test_roc_auc", "test_pr_auc", "test_ks", "test_brier")


def model_info(spark: SparkSession, settings: Settings, n_features: int) -> DataFrame:
    """What is served: name, version, stage, feature count, contract hash and headline metrics."""
    log = events(spark, settings)
    served = served_version(log).select(F.col("version").alias("served"))
    keys = F.array(*map(F.lit, INFO_METRICS))
    return versions(log).join(F.broadcast(served), F.col("version") == F.col("served")).select(
        F.lit(settings.model_name).alias("registered_model_name"),
        "version",
        "stage",
        F.lit(n_features).alias("n_features"),
        F.col("tags")["feature_config_hash"].alias("feature_config_hash"),
        F.map_filter("metrics", lambda k, _: F.array_contains(keys, k)).alias("metrics"),
    )
