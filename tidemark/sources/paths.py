"""Existence checks and source choice through the Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..settings import Settings


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def child_paths(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return [status.getPath().toString() for status in found]


def resolve_source(spark: SparkSession, source: str | None = None, settings: Settings | None = None) -> str:
    """An explicit source, else the landed Parquet, else the sample; an error if there is none."""
    settings = settings or Settings()
    candidates = [source] if source is not None else [settings.raw_parquet, settings.sample_csv]
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no loan data at {' or '.join(candidates)}; land the raw CSV first")
