"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on wherever they run. Partition counts are left to the cluster:
# adaptive execution merges small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_own_roots: dict[str, str] = {}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    local = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        # Small test files would otherwise all be packed into one task.
        "spark.sql.files.openCostInBytes": "65536",
    }
    for key, value in {**BASE_CONF, **local, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for derived tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to
    a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(_own_roots[app] + "/checkpoints")
        root = _own_roots[app]
    return f"{root.rstrip('/')}/tidemark/{app}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    For results several jobs read: nothing upstream runs again, and a lost executor costs a
    re-read, not a recomputation.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
