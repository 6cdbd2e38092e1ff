"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .splitters import splitters

ROW_BYTES = 16
# Rows that are numbered in one task.
ROWS_PER_PIECE = 200_000


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Deal all documents into ``shards`` consecutive ranges of doc_id with near equal bytes.

    A row weighs the UTF-8 bytes of its text (none for null) plus 16. With ``before`` the
    weight of all rows before it in order of doc_id, a row goes to shard ``before * shards div
    total``: a shard is off its share by less than its first and last row. Splitters are found
    by repeated histograms, then every row is exchanged once, to its shard.

    Columns: ``doc_id``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (0 to
    the number of rows of the shard less one, in order), ``grown_shard`` (null: only a law
    that goes by the key has one) and, in a struct ``carried``, those named in ``carry``. Null ids come first; rows that
    share an id, repeated rows too, stand in order of input, so that they split like any other. Null texts
    have the checksum of empty text. An empty table gives an empty one.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.col(doc_id).cast("bigint")
    low = F.shiftleft(F.lit(1).cast("bigint"), 32) - 1
    keyed = docs.select(
        number.alias("doc_id"),
        *([F.struct(*carry).alias("carried")] if carry else []),
        (F.octet_length(value).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        # Nulls first, and the id in two halves that no difference can overflow.
        F.coalesce(F.shiftright(number, 32), F.lit(-(1 << 33))).alias("high"),
        F.coalesce(number.bitwiseAND(low), F.lit(0).cast("bigint")).alias("low"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).alias("all"),
    )
    keyed = materialise(keyed, "shard-keys")  # fixes the order of rows that share an id
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [(0, i, -(-i * total // shards)) for i in range(1, shards)]
    wanted = keyed.sparkSession.createDataFrame(targets, "all int, target_id int, target bigint") if targets else None
    bounds = []
    if total and wanted is not None:
        cut = splitters(keyed, wanted, "all", ["high", "low", "row"], "size")
        bounds = sorted(
            # The row that holds the target starts the shard only if it stands exactly at it.
            (r["high"], r["low"], r["row"] if r["below"] == r["target"] else r["row"] + 1)
            for r in cut.select("high", "low", "row", "below", "target").collect()  # one per shard
        )
    place = F.lit(0)
    for high, lower, row in bounds:
        same = (F.col("high") == high) & ((F.col("low") > lower) | ((F.col("low") == lower) & (F.col("row") >= row)))
        place = place + F.when((F.col("high") > high) | same, 1).otherwise(0)
    dealt = keyed.withColumn("shard", place.cast("int"))
    return _with_slots(dealt, rows_per_piece).select(
        F.col("doc_id").alias(doc_id),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        *(["carried"] if carry else []),
    )


def _with_slots(dealt: DataFrame, rows_per_piece: int) -> DataFrame:
    """Number the rows of each shard from 0: shards are cut into pieces of their id range, each
    piece is numbered on its own, and starts after the pieces before it.
    """
    span = dealt.groupBy("shard").agg(
        F.min("doc_id").cast("double").alias("least"), F.max("doc_id").cast("double").alias("most"), F.count(F.lit(1)).alias("n")
    )
    pieces = F.ceil(F.col("n") / rows_per_piece)
    part = F.floor((F.col("doc_id").cast("double") - F.col("least")) / (F.col("most") - F.col("least") + 1) * pieces)
    cut = dealt.join(F.broadcast(span), "shard")  # one row per shard
    cut = cut.withColumn("piece", F.least(F.coalesce(part, F.lit(0)), pieces - 1).cast("int")).drop("least", "most", "n")
    counts = cut.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("high", "low", "row")
    numbered = cut.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "piece"]).withColumn("slot", (F.col("start") + F.col("at")).cast("bigint"))
