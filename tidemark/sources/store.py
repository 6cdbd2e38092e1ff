"""The feature store on disk: one Parquet table partitioned by split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import FeatureContract, assert_lineage, assert_no_leakage, feature_columns_of, load_contract
from ..operators.features import RAW_INPUT_COLUMNS, engineer_features
from ..operators.split import SPLIT_NAMES, split_summary, time_split
from ..settings import Settings
from .paths import path_exists, resolve_source
from .readers import read_loans


@dataclass(frozen=True)
class FeatureStore:
    """Split feature rows with the hash of the contract they were built under."""

    frame: DataFrame
    config_hash: str
    path: str | None = None

    def split(self, name: str) -> DataFrame:
        if name not in SPLIT_NAMES:
            raise ValueError(f"unknown split {name!r}; expected one of {SPLIT_NAMES}")
        return self.frame.where(F.col("split") == name).drop("split")

    def summary(self) -> DataFrame:
        return split_summary(self.frame)


def build_feature_store(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    source: str | DataFrame | None = None,
    write: bool = True,
    contract: FeatureContract | None = None,
) -> FeatureStore:
    """Read, engineer, guard, split and (optionally) write. Files are written per split value."""
    settings, contract = settings or Settings(), contract or load_contract()
    raw = source if isinstance(source, DataFrame) else read_loans(spark, resolve_source(spark, source, settings))
    frame = engineer_features(raw, contract)
    assert_no_leakage(feature_columns_of(frame, contract), contract, consumed=RAW_INPUT_COLUMNS)
    assert_lineage(frame, contract)
    split = time_split(frame, settings, contract)
    if not write:
        return FeatureStore(split, contract.config_hash)
    path = settings.features_dir
    split.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)
    return FeatureStore(spark.read.parquet(path), contract.config_hash, path)


def load_store(spark: SparkSession, settings: Settings | None = None) -> FeatureStore:
    settings = settings or Settings()
    path = settings.features_dir
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no feature store at {path}; build it first")
    return FeatureStore(spark.read.parquet(path), load_contract().config_hash, path)


def load_split(spark: SparkSession, name: str, settings: Settings | None = None) -> DataFrame:
    """One split; the filter prunes partitions, so only its files are read."""
    if name not in SPLIT_NAMES:
        raise ValueError(f"unknown split {name!r}; expected one of {SPLIT_NAMES}")
    return load_store(spark, settings).split(name)


def load_or_build(
    spark: SparkSession, settings: Settings | None = None, source: str | DataFrame | None = None
) -> FeatureStore:
    """An explicit source is built without writing; otherwise the stored table, built when absent."""
    if source is not None:
        return build_feature_store(spark, settings, source=source, write=False)
    try:
        return load_store(spark, settings)
    except FileNotFoundError:
        return build_feature_store(spark, settings)
