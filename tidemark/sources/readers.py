"""Reading raw loans and landing them as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import load_contract
from ..functions import columns as fx
from ..settings import Settings
from .paths import path_exists

# The raw columns every source has, with their types.
RAW_TYPES = {
    "id": "bigint",
    "issue_d": "string",
    "revenue": "double",
    "dti_n": "double",
    "loan_amnt": "double",
    "fico_n": "double",
    "experience_c": "int",
    "emp_length": "string",
    "purpose": "string",
    "home_ownership_n": "string",
    "addr_state": "string",
    "zip_code": "string",
    "Default": "tinyint",
    "title": "string",
    "desc": "string",
}
REQUIRED_COLUMNS = tuple(RAW_TYPES)


def read_csv(spark: SparkSession, path: str, *, infer: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header. Known columns get their types by name, others stay text.

    ``infer`` looks at all rows to type every column instead. ``desc`` may hold line breaks,
    and a file read with ``multi_line`` is one task; sources known to have none should say
    so, then large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    if infer:
        return reader.option("inferSchema", True).csv(path)
    text = reader.csv(path)
    return text.select(
        *[
            F.col(f"`{c}`").try_cast(RAW_TYPES[c]).alias(c) if c in RAW_TYPES else F.col(f"`{c}`")
            for c in text.columns
        ]
    )


def read_loans(spark: SparkSession, path: str, **csv_options: bool) -> DataFrame:
    """Parquet or CSV by suffix."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, **csv_options)


def land_raw(
    spark: SparkSession, settings: Settings, *, force: bool = False, csv_path: str | None = None, **csv_options: bool
) -> str:
    """CSV to ZSTD Parquet with the parsed issue date added; an existing landing is kept unless forced."""
    out = settings.raw_parquet
    if path_exists(spark, out) and not force:
        return out
    contract = load_contract()
    raw = read_csv(spark, csv_path or settings.raw_csv, **csv_options)
    dated = raw.withColumn(contract.split_date_column, fx.month_start(F.col(contract.time_column)))
    dated.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return out


def validate_source(df: DataFrame) -> DataFrame:
    """One row: missing columns, row count, bad targets, ``valid``. Counts in one pass."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    names = F.array(*map(F.lit, missing)) if missing else F.array().cast("array<string>")
    bad = F.lit(None).cast("bigint")
    if "Default" in df.columns:
        y = F.col("`Default`").try_cast("double")
        bad = F.count_if(y.isNull() | ~y.isin(0.0, 1.0))
    ok = F.lit(not missing) & (F.col("n_rows") > 0) & (F.coalesce("bad_targets", F.lit(0)) == 0)
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("bad_targets"))
        .withColumn("missing_columns", names)
        .withColumn("valid", ok)
    )
