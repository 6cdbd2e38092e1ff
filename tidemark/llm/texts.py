"""Small helpers for operators that read text in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators of words in the contracts that say [^\x20\x09-\x0D]+; bytes.split() cuts at
# exactly these six, and bytes.lower() lowers A-Z only.
SPACES = " \t\n\x0b\x0c\r"
_BATCH_BYTES = 1 << 20
_CROSSING_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have rows cross to Python in batches of a few megabytes, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_CROSSING_BYTES))


def narrow(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """The columns an operator reads, null text as empty text."""
    small_batches(docs.sparkSession)
    return docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text), *more)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it while a column of the frames has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        column = batch.column(text)
        if not len(column):
            continue
        if column.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.binary_length(column).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()
