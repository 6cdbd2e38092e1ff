"""SimHash near-duplicates through an inverted index of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import BLOCK_ROWS, Forest, blocks, components
from .texts import as_bytes, narrow, slices

SEED = 42
_BYTES = 8
_SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the word shingles of one text, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        span = slice(at, at + _SHINGLES_AT_ONCE)
        pairs = zip(starts[span].tolist(), ends[span].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row. Null and wordless texts have fingerprint zero."""
    rows = narrow(docs, text=text, doc_id=doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [fingerprint(t, shingle) for t in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(found, pa.int64())], [doc_id, "fp"])

    return rows.mapInArrow(run, f"{doc_id} {rows.schema[doc_id].dataType.simpleString()}, fp bigint")


def clean_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any two fingerprints within ``max_bits`` agree on one.

    ``max_bits`` differing bits touch at most that many of the 8 bytes, so at least
    ``8 - max_bits`` positions agree. For 4 agreeing positions a Turan system of 20 triples
    holds a triple inside every 4-set: positions in three classes, triples within a class or
    with two in one class and one in the next. Otherwise all sets of the guaranteed size.
    """
    agreeing = _BYTES - max_bits
    if agreeing < 1:
        raise ValueError("the byte index needs max_bits below 8")
    if agreeing != 4:
        return list(combinations(range(_BYTES), min(agreeing, 3)))
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [c for c in classes if len(c) == 3]
    for i, own in enumerate(classes):
        following = classes[(i + 1) % 3]
        found += [tuple(sorted((*pair, z))) for pair in combinations(own, 2) for z in following]
    return sorted(found)


def _keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """One number per position set: the set and the fingerprint bytes at its positions."""

    def key(number: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(number).cast("bigint")
        for p in positions:
            byte = F.shiftrightunsigned(fp, 8 * (_BYTES - 1 - p)).bitwiseAND(F.lit(255).cast("bigint"))
            out = F.shiftleft(out, 8).bitwiseOR(byte)
        return out

    return F.array(*[key(i, s) for i, s in enumerate(sets)])


def linked_in_list(fps: np.ndarray, max_bits: int) -> Forest:
    """Links among the fingerprints of one block, as a forest.

    Positional bytes shared by a pair are tallied; pairs with fewer than the guaranteed
    number are dropped, the others verified by their differing bits.
    """
    forest, least = Forest(len(fps)), _BYTES - max_bits
    for i in range(len(fps) - 1):
        differing = fps[i + 1 :] ^ fps[i]
        shared = (differing.view(np.uint8).reshape(-1, _BYTES) == 0).sum(axis=1)
        at = np.nonzero(shared >= least)[0]
        for j in at[np.bitwise_count(differing[at]) <= max_bits].tolist():
            forest.join(i, i + 1 + j)
    return forest


def simhash_links(nodes: DataFrame, *, max_bits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between representatives whose fingerprints differ in at most ``max_bits`` bits.

    ``nodes`` has one row per fingerprint (fp, rep). Posting lists of single byte positions
    hold a 256th of all rows each, so the lists are intersected over position sets before
    anything is compared. Of each list only a spanning forest of its links comes out.
    """
    posted = nodes.select("fp", "rep", F.explode(_keys(F.col("fp"), clean_sets(max_bits))).alias("key"))
    lists = blocks(posted, ["key"], F.xxhash64("fp"), F.struct("fp", "rep"), block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            cuts, flat = column.offsets.to_numpy(), column.values
            fps = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            reps = flat.field(1).to_numpy(zero_copy_only=False)
            left, right = [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                member, root = linked_in_list(fps[i:j], max_bits).edges()
                left.append(reps[i:j][member])
                right.append(reps[i:j][root])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["a", "b"])

    return lists.select("members").mapInArrow(run, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame,
    *,
    shingle: int = 4,
    max_bits: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Near-duplicate groups by SimHash: one row per input row.

    Columns: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id
    reachable over fingerprints at most ``max_bits`` bits apart, itself included), ``kept``
    (whether this row's id is that smallest one).

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows that
    repeat a doc_id are one node of the graph. A null doc_id gets the smallest id of its group,
    or null, and is kept only when its group has no id. Other columns are not read.
    """
    fps = materialise(
        fingerprints(docs, shingle=shingle, doc_id=doc_id, text=text).withColumnRenamed(doc_id, "doc_id"), "fingerprints"
    )
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    known = nodes.where("rep is not null")
    # A doc_id that repeats with another text joins the fingerprints it stands for.
    links = simhash_links(known, max_bits=max_bits, block_rows=block_rows)
    same_id = fps.join(known, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    several = repeated.where("lo <> hi").select("doc_id")
    links = links.union(same_id.join(several.withColumnRenamed("doc_id", "a"), "a").select("a", "b"))
    groups = components(links).withColumnsRenamed({"node": "rep"})
    labelled = nodes.join(groups, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(labelled, "fp")
    return out.select(
        F.col("doc_id").alias(doc_id),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
