"""Time split and what is known about the pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import FeatureContract, load_contract
from ..session import materialise
from ..settings import Settings

SPLIT_NAMES = ("train", "valid", "test")
# Buckets that two tables are compared by, and the columns they are told by meanwhile.
BUCKETS = 4096
_HASH, _SECOND, _BUCKET, _SIDE = "__row_hash", "__row_hash_2", "__row_bucket", "__row_side"


def split_label(date: Column, settings: Settings) -> Column:
    train_end = F.lit(settings.train_end).cast("date")
    valid_end = F.lit(settings.valid_end).cast("date")
    return (
        F.when(date <= train_end, F.lit("train")).when(date <= valid_end, F.lit("valid")).otherwise(F.lit("test"))
    )


def time_split(
    frame: DataFrame, settings: Settings | None = None, contract: FeatureContract | None = None
) -> DataFrame:
    """Add the ``split`` column. Undated rows are an error, reported with their count."""
    contract, settings = contract or load_contract(), settings or Settings()
    date = F.col(contract.split_date_column)
    undated = frame.select(F.count_if(date.isNull()).alias("n")).first()["n"]
    if undated:
        raise ValueError(f"{undated} row(s) without a usable {contract.split_date_column}; cannot split by time")
    return frame.withColumn("split", split_label(date, settings))


def expanded_window(frame: DataFrame) -> DataFrame:
    """Train and valid rows together."""
    return frame.where(F.col("split").isin("train", "valid"))


def split_summary(frame: DataFrame, contract: FeatureContract | None = None) -> DataFrame:
    """Rows, date span and default rate for each of the three splits, empty ones included."""
    contract = contract or load_contract()
    date, target = F.col(contract.split_date_column), F.col(f"`{contract.target}`")
    found = frame.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
        F.avg(target.cast("double")).alias("default_rate"),
    )
    names = frame.sparkSession.createDataFrame([(n,) for n in SPLIT_NAMES], "split string")
    return names.join(found, "split", "left").withColumns(
        {"rows": F.coalesce("rows", F.lit(0)), "default_rate": F.coalesce("default_rate", F.lit(float("nan")))}
    )


def split_integrity(frame: DataFrame, settings: Settings, contract: FeatureContract | None = None) -> DataFrame:
    """One row: total rows, rows per split, rows outside their window, ids in more than one split."""
    contract = contract or load_contract()
    key = contract.id_columns[0]
    wrong = F.col("split") != split_label(F.col(contract.split_date_column), settings)
    # Grouping by id puts every copy of an id side by side without comparing the splits pairwise.
    per_id = frame.groupBy(key).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLIT_NAMES],
        F.count_if(wrong).alias("misplaced"),
        F.count(F.lit(1)).alias("n"),
    )
    homes = sum((F.col(s) > 0).cast("int") for s in SPLIT_NAMES)
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*SPLIT_NAMES, "misplaced")]
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *totals, F.count_if(homes > 1).alias("shared_ids")
    )


def _with_bucket(df: DataFrame) -> DataFrame:
    """``df`` with two 64-bit hashes of the row and the bucket it falls into."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # A hash passes over nulls, so where they are is hashed too.
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    first = F.xxhash64(nulls, *columns)
    return df.withColumns({_HASH: first, _SECOND: F.xxhash64(F.lit("again"), nulls, *columns), _BUCKET: F.pmod(first, F.lit(BUCKETS))})


def differing_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Buckets whose rows are not the same on both sides, by sums that no order or dealing changes."""

    def sums(df: DataFrame, sign: int) -> DataFrame:
        wide = [F.col(h).cast("decimal(20,0)") * sign for h in (_HASH, _SECOND)]
        parts = [F.sum(w).alias(n) for n, w in zip(("a", "b"), wide)]
        return df.groupBy(_BUCKET).agg(F.sum(F.lit(sign).cast("bigint")).alias("n"), *parts)

    both = sums(_with_bucket(left), 1).unionAll(sums(_with_bucket(right), -1)).groupBy(_BUCKET)
    off = both.agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")]).where("n <> 0 or a <> 0 or b <> 0")
    return sorted(r[_BUCKET] for r in off.select(_BUCKET).collect())  # at most BUCKETS numbers


def rows_only_in_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either frame without an equal partner in the other, duplicates counted.

    Both sides are added up per bucket of row hashes first, without moving a row; only rows of
    buckets that differ are compared, by one shuffle of both sides. Two sides whose sums agree are taken as equal.
    """
    right = right.select(*left.columns) if set(left.columns) == set(right.columns) else right.toDF(*left.columns)
    if not (buckets := differing_buckets(left, right)):
        return left.limit(0)
    some = [left, right]
    # Where most buckets differ, a copy of the rows would only leave out the few that do not.
    if 2 * len(buckets) < BUCKETS:
        # Written first: a filter on the hash of columns would be pushed below what makes them, and make them again.
        numbers = F.broadcast(left.sparkSession.createDataFrame([(b,) for b in buckets], f"`{_BUCKET}` bigint"))
        some = [materialise(_with_bucket(side), "bucketed").join(numbers, _BUCKET, "left_semi") for side in some]
    names = [f"`{c}`" for c in left.columns]
    signed = [side.select(*names, F.lit(sign).alias(_SIDE)) for side, sign in zip(some, (1, -1))]
    found = signed[0].unionAll(signed[1]).groupBy(*names).agg(F.sum(_SIDE).alias(_SIDE)).where(F.col(_SIDE) != 0)
    return found.withColumn(_SIDE, F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs(_SIDE)))).select(*names)
