"""Small tables on the driver, only where their size is proven."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# A table of this many narrow rows is a few megabytes on every executor.
MAX_BROADCAST_ROWS = 100_000


MAX_BROADCAST_BYTES = 16 << 20


class TooManyRows(ValueError):
    pass


def small_rows(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> list[Row]:
    """All rows of ``df``, which must have at most ``max_rows``; never fetches more than that.

    Text, which may be of any length, is measured before it is fetched.
    """
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    if texts:
        size = df.limit(max_rows + 1).agg(F.sum(sum(texts[1:], texts[0]).cast("bigint"))).first()[0] or 0
        if size > MAX_BROADCAST_BYTES:
            raise TooManyRows(f"{size} bytes of text in {max_rows} rows")
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"more than {max_rows} rows")
    return rows


def small_table(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` held by the driver when it has at most ``max_rows`` rows, so that it is not computed
    again; unchanged otherwise."""
    try:
        return df.sparkSession.createDataFrame(small_rows(df, max_rows), df.schema)
    except TooManyRows:
        return df


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``max_rows`` rows.

    A larger one comes back unchanged and without a hint, so that a join with it shuffles.
    """
    try:
        rows = small_rows(df, max_rows)
    except TooManyRows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_bounded(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null matching null; ``right`` is broadcast when it proves small.

    The key columns of the result are those of ``left``.
    """
    theirs = {c: f"__right_{c}" for c in keys}
    right = broadcast_if_small(right.withColumnsRenamed(theirs))
    on = [F.col(c).eqNullSafe(F.col(theirs[c])) for c in keys]
    return left.join(right, on, how).drop(*theirs.values())
