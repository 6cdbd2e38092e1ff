"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once. The top of the hash names a bin, the rest competes for the bin's
minimum. Empty bins take the minimum of another bin by optimal densification (Shrivastava
2017), and of each bin a few low-order bits are stored (Li and Koenig 2010).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .texts import narrow, slices

SHINGLE = 5
BINS = 512
BITS = 4
# Words whose hashes a worker remembers, and texts whose bins it holds at a time. They bound
# memory only.
_CACHE_WORDS = 200_000
_TEXTS_AT_ONCE = 1024
_BLOCK = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
# Odd numbers that the 64-bit hashes are multiplied with.
_STEP, _FIRST, _SECOND = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation whose bits all depend on all bits of ``x`` (Steele et al. 2014)."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a minimum: a random one of its own.

    Asking bins drawn at random until one is not empty, as the method does, never gains from
    asking one twice; without repeats the order is a permutation, and the search ends.
    """
    at = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return _mixed((at + np.uint64(1)) * _STEP).argsort(axis=1, kind="stable").astype(np.int32)


class Fingerprints:
    """Fingerprints of one worker; ``of`` gives the low bits of all bins, one byte a bin."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or not 1 < bins <= 1 << 12 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two up to 4096, bits 1, 2, 4 or 8")
        self.shingle, self.bins, self.bits = shingle, bins, bits
        self.known: dict[bytes, int] = {}

    def _word_hashes(self, raw: bytes) -> list[np.ndarray]:
        out, start = [], 0
        while start < len(raw):
            end = len(raw)
            if end - start > _BLOCK and (cut := _SPACE.search(raw, start + _BLOCK)):
                end = cut.end()
            words = raw[start:end].split()
            found = list(map(self.known.get, words))
            for i in [i for i, h in enumerate(found) if h is None]:
                found[i] = h = xxhash.xxh64_intdigest(words[i])
                if len(self.known) >= _CACHE_WORDS:
                    self.known.clear()
                if len(words[i]) < 64:
                    self.known[words[i]] = h
            out.append(np.array(found, np.uint64))
            start = end
        return out

    def _shingles(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles and the number of the text of each; every text has at least one."""
        parts, sizes = [], []
        for raw in texts:
            hashes = self._word_hashes(raw)
            sizes.append(sum(map(len, hashes)))
            parts.extend(hashes)
        words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        size = np.array(sizes, np.int64)
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(texts)), size)
        n = max(0, len(words) - self.shingle + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(self.shingle):
            rolled = _mixed(rolled * _STEP + words[j : j + n] + np.uint64(1))
        inside = np.arange(n) + self.shingle <= ends[owner[:n]]
        found, of = [rolled[inside]], [owner[:n][inside]]
        for i in np.nonzero(size < self.shingle)[0]:  # the whole sequence, down to none, is one shingle
            whole = np.full(1, size[i], np.uint64)
            for w in words[ends[i] - size[i] : ends[i]]:
                whole = _mixed(whole * _STEP + w + np.uint64(1))
            found.append(_mixed(whole + _STEP))
            of.append(np.full(1, i))
        return np.concatenate(found), np.concatenate(of)

    def of(self, texts: Sequence[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.bins), np.uint8)
        hashes, owner = self._shingles(texts)
        free = np.uint64(64 - self.bins.bit_length() + 1)
        least = np.full(len(texts) * self.bins, _NONE)
        place = owner * self.bins + (hashes >> free).astype(np.int64)
        np.minimum.at(least, place, hashes & ((np.uint64(1) << free) - np.uint64(1)))
        least = least.reshape(len(texts), self.bins)
        full = least != _NONE
        row, bin_ = np.nonzero(~full)
        probes = _probes(self.bins)
        for attempt in range(self.bins):
            if not len(row):
                break
            asked = probes[bin_, attempt]
            has = full[row, asked]
            least[row[has], bin_[has]] = least[row[has], asked[has]]
            row, bin_ = row[~has], bin_[~has]
        # Low bits of a hash of minimum and bin: a minimum lent to many bins agrees by chance in
        # each of them apart, as the correction of the bias assumes.
        bits = _mixed(least * _STEP + np.arange(self.bins, dtype=np.uint64))
        return (bits & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, low: np.ndarray) -> list[bytes]:
        """The low bits of each row of ``low`` as bytes, the first bin in the highest bits."""
        each = 8 // self.bits
        shifts = np.arange(8 - self.bits, -1, -self.bits)
        grouped = low.reshape(len(low), self.bins // each, each) if self.bins >= each else low.reshape(len(low), 1, -1)
        return [r.tobytes() for r in (grouped.astype(np.uint16) << shifts[: grouped.shape[2]]).sum(2).astype(np.uint8)]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity of the shingle sets: agreeing bins less those that agree by chance."""
        chance = 1 / (1 << self.bits)
        return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def _compared(maker: Fingerprints, ids: list, texts: list[str], low: np.ndarray) -> list[pa.Array]:
    """Result columns of all texts but the last, each beside the next one; ``low``: bits of all of them."""
    edits = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    low_edits = maker.of(edits)
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e).digest() for e in edits], pa.binary()),
        pa.array(maker.packed(low[:-1]), pa.binary()),
        pa.array(maker.packed(low_edits), pa.binary()),
        pa.array(maker.likeness(low[:-1], low_edits), pa.float64()),
        pa.array(maker.likeness(low[:-1], low[1:]), pa.float64()),
    ]


def fingerprint_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Shingles are runs of ``shingle`` words ``[^\\x20\\x09-\\x0D]+``, case kept; fewer words are one
    shingle as a whole, none too (texts without words are alike). Result per row: ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hex of the packed bits),
    ``near_edited``, ``near_next``. The next document is the next row in order of doc_id, nulls
    first, rows that share an id in order of a hash of their texts, and the first row after the
    last. A null text is an empty one. Other columns are not read; an empty table gives an empty one.

    Rows are exchanged once, into ranges of this order. A task meets all neighbours but that of its
    last row; it hands over its first and last row, and these few are compared afterwards.
    """
    rows = narrow(docs, text=text, doc_id=doc_id).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = [*_RESULT, "part", "edge", "edge_text"]

    def edge(part: int, kind: int, number: int | None, content: str) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        columns = [pa.array([number], pa.int64()), *none, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([content])]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, part = Fingerprints(shingle, bins, bits), TaskContext.get().partitionId()
        last: tuple[list, list[str], np.ndarray] | None = None
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                piece = batch.slice(at, _TEXTS_AT_ONCE)
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                low = maker.of([t.encode() for t in texts])
                if last is None:
                    yield edge(part, 1, ids[0], texts[0])
                else:
                    ids, texts, low = last[0] + ids, last[1] + texts, np.concatenate((last[2], low))
                last = ids[-1:], texts[-1:], low[-1:]
                if len(texts) > 1:
                    found = _compared(maker, ids, texts, low)
                    n, none = len(texts) - 1, pa.int32()
                    yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, none), pa.nulls(n, none), pa.nulls(n, pa.string())], names)
        if last is not None:
            yield edge(part, 2, last[0][0], last[1][0])

    # Written, so that the edges stem from the very ranges that the rows were dealt into.
    found = materialise(ordered.mapInArrow(run, f"{_SCHEMA}, part int, edge int, edge_text string"), "fingerprints")

    firsts, lasts = found.where("edge = 1"), found.where("edge = 2")
    order = Window.orderBy("part")  # numbers of the tasks that had rows, one row each
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = firsts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("turn"))
    following = firsts.select(F.col("part").alias("turn"), F.col("edge_text").alias("next_text"))
    met = lasts.join(turns, "part").join(following, "turn").select("doc_id", F.col("edge_text").alias("text"), "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprints(shingle, bins, bits)
        for batch in batches:
            for r in range(batch.num_rows):
                number, own, following_text = (batch.column(c)[r].as_py() for c in ("doc_id", "text", "next_text"))
                low = maker.of([own.encode(), following_text.encode()])
                yield pa.RecordBatch.from_arrays(_compared(maker, [number, None], [own, following_text], low), list(_RESULT))

    every = found.where("edge is null").select(*_RESULT).unionByName(met.mapInArrow(close, _SCHEMA))
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return every.withColumns(shown).withColumnRenamed("doc_id", doc_id)
