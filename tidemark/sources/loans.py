"""The provided star-schema tables seen as raw loan applications.

The tables hold no loans; label and several columns are invented stand-ins that exercise
every operator. The view is landed once per session as Parquet, as any raw source would be.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import ReferenceBins, fit_reference
from ..operators.features import engineer_features
from ..operators.split import time_split
from ..session import work_dir
from ..settings import Settings

# Cut-off dates that split the provided order dates (1995 to 2001).
VIEW_SETTINGS = Settings(train_end="1998-12-31", valid_end="1999-12-31")

_lock = threading.RLock()
_landed: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw loan row per order.

    The customer join runs on ``o_custkey``; the line totals and the text join then share
    one shuffle on the order key, into which orders go with no more than what they become.
    Nations are looked up afterwards. "Not the customer's first order" is a comparison with a
    pre-aggregated minimum instead of a ranking, so a customer with very many orders never
    has to be sorted in one task.
    """
    orders = table(spark, sf_dir, "orders")
    placed = F.struct(F.col("o_orderdate"), F.col("o_orderkey"))
    first = orders.groupBy(F.col("o_custkey").alias("first_custkey")).agg(F.min(placed).alias("first_placed"))
    customers = (
        table(spark, sf_dir, "customer")
        .join(first, F.col("c_custkey") == F.col("first_custkey"))
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey", "first_placed")
    )
    placed_by = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
        "c_mktsegment",
        "c_nationkey",
        F.greatest("c_acctbal", F.lit(0.0)).alias("revenue"),
        F.when(placed > F.col("first_placed"), 1).otherwise(0).alias("experience_c"),
        (F.col("o_custkey") % 1000).alias("zip"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("c_name")).alias("title"),
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            # Rounded: the last bits of an average depend on the order rows are summed in.
            F.round(F.avg("l_discount") * 100, 6).alias("dti"),
            F.avg("l_quantity").alias("quantity"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        )
    )
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.col("n_lines")
    month = F.date_trunc("month", "o_orderdate")
    return (
        placed_by.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(texts, F.col("o_orderkey") == F.col("doc_id"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
            "revenue",
            F.col("dti").alias("dti_n"),
            F.col("o_totalprice").alias("loan_amnt"),
            (F.lit(300) + 11 * F.col("quantity")).alias("fico_n"),
            "experience_c",
            F.when(n_lines.isNull(), "NI")
            .when(n_lines == 1, "< 1 year")
            .when(n_lines >= 10, "10+ years")
            .otherwise(F.concat(n_lines.cast("string"), F.lit(" years")))
            .alias("emp_length"),
            F.col("o_orderpriority").alias("purpose"),
            F.col("c_mktsegment").alias("home_ownership_n"),
            F.col("n_name").alias("addr_state"),
            F.concat(F.lpad(F.col("zip").cast("string"), 3, "0"), F.lit("xx")).alias("zip_code"),
            F.coalesce("returned", F.lit(0)).cast("tinyint").alias("Default"),
            "title",
            F.col("text").alias("desc"),
            month.cast("date").alias("issue_date"),
        )
    )


def land_once(spark: SparkSession, sf_dir: str, what: str, write: Callable[[str], None]) -> str:
    """Path of a derived table, written by ``write`` the first time a session asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    with _lock:
        if key not in _landed:
            path = f"{work_dir(spark)}/{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}/{what}"
            write(path)
            _landed[key] = path
        return _landed[key]


def landed_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        loan_view(spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)

    return land_once(spark, sf_dir, "loans", write)


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed loan view: every later scan reads only the columns it needs."""
    return spark.read.parquet(landed_path(spark, sf_dir))


def loan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed, time-split feature table of the loan view, partitioned by split."""

    def write(path: str) -> None:
        frame = time_split(engineer_features(raw_loans(spark, sf_dir)), VIEW_SETTINGS)
        frame.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)

    return spark.read.parquet(land_once(spark, sf_dir, "features", write))


def loan_reference(spark: SparkSession, sf_dir: str) -> ReferenceBins:
    """Frozen decile bins of the train split, kept beside the features."""

    def write(path: str) -> None:
        train = loan_features(spark, sf_dir).where(F.col("split") == "train")
        fit_reference(train).to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    return ReferenceBins.from_frame(spark.read.parquet(land_once(spark, sf_dir, "reference", write)))
