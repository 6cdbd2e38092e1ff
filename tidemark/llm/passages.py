"""Passages that repeat across documents, found by chaining shared k-mers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .texts import as_bytes, slices, small_batches, unused

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class PassageRules:
    """What counts as a repeated passage.

    ``min_words`` words of a document, at least ``identity`` of which stand in the same order in
    the other one, with nowhere more than ``max_gap`` words between two matching places. The search
    uses every run of ``k`` words. ``window`` is for ``seeds_of``, which samples them: the smallest
    hash in some ``window`` of them, so an equal run of ``k + window - 1`` words always shares one.
    """

    min_words: int = 50
    identity: float = 0.8
    k: int = 5
    window: int = 8
    max_gap: int = 30
    margin: int = 64
    # Words that a part of a passage put together from parts that stand elsewhere spans at least.
    least_part: int = 12
    # Most bits of the membership filter that keeps documents without matches out of the shuffle:
    # eight a document while they fit. A full filter costs time, not results.
    filter_bits: int = 1 << 27


def _mix(keys: np.ndarray) -> np.ndarray:
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return keys


def runs_of_all(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their number by text) of all runs of ``k`` words by word position, letters A-Z lowered."""
    found = []
    for text in texts:
        words = text.lower().split()
        found.append(np.fromiter(map(crc32, words), np.uint64, len(words)))
    single = np.concatenate(found) if found else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    total = len(single)
    n = max(0, total - k + 1)
    mixed = single[:n].copy()
    for i in range(1, k):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += single[i : n + i]
    counts = np.maximum(sizes - k + 1, 0)
    # The last runs of a text go on into the next one.
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(counts, sizes)
    return _mix(mixed[within[:n]]), counts


def runs_of(text: bytes, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text by word position, letters A-Z lowered."""
    return runs_of_all([text], k)[0]


def seeds_of(text: bytes, rules: PassageRules) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of sampled runs of one text, letters A-Z lowered."""
    mixed = runs_of(text, rules.k)
    n = len(mixed)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    if n <= rules.window:
        at = np.array([int(mixed.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(mixed, rules.window)
        at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return mixed[at].view(np.int64), at.astype(np.int32)


@contextmanager
def _freed_shuffles(docs: DataFrame) -> Iterator[None]:
    """Shuffle files of queries run inside go when these end; nothing reads them again."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", docs.sparkSession.conf
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


# Hashes are sorted into buckets by their first bits; of the next 32 bits a bucket's cells are the first.
_BUCKET_BITS, _CELL_BITS = 12, 15
_HELD_HASHES = 1 << 21
# Texts of more bytes than this fill the bitmap, so it is left out and every run is a seed.
_BITMAP_TEXT_BYTES = 1 << 33


def _packed(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(bucket, hashes): sorted 32-bit numbers, none more than twice, of texts with so many hashes each."""
    bits = np.uint64(_BUCKET_BITS + 32)
    found = hashes >> (np.uint64(64) - bits)
    # A text's repeats count once. With its number behind the hash one sort finds them, while both fit.
    if len(counts) <= 1 << int(np.uint64(64) - bits):
        tagged = found << (np.uint64(64) - bits) | np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        tagged.sort()
        once = np.ones(len(tagged), bool)
        once[1:] = tagged[1:] != tagged[:-1]
        found = tagged[once] >> (np.uint64(64) - bits)
    else:
        cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
        found = np.sort(np.concatenate([np.unique(found[i:j]) for i, j in zip(cuts, cuts[1:])]))
    often = np.zeros(len(found), bool)
    often[2:] = found[2:] == found[:-2]
    found = found[~often]
    cuts = np.searchsorted(found >> np.uint64(32), np.arange((1 << _BUCKET_BITS) + 1, dtype=np.uint64))
    low = found.astype(np.uint32)
    full = np.nonzero(np.diff(cuts))[0]
    blobs = [low[cuts[i] : cuts[i + 1]].tobytes() for i in full.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "hashes"])


def _shared_cells(docs: DataFrame, rules: PassageRules) -> np.ndarray:
    """A bitmap of fixed size over the first bits of hashes: cells that hold a run of two rows.

    It only spares the shuffle runs that one row alone holds; those that pass by chance are
    dropped by the counts afterwards. Four bytes a run are shuffled for it, and a bucket gathers
    a 4,096th of the runs of at most ``_BITMAP_TEXT_BYTES``, so about 2 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            held.append(runs_of_all(as_bytes(batch.column("text")), rules.k))
            size += len(held[-1][0])
            if size >= _HELD_HASHES:
                yield _packed(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield _packed(*map(np.concatenate, zip(*held)))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for blobs in batch.column("hashes").to_pylist():
                found = np.sort(np.frombuffer(b"".join(blobs), np.uint32))
                bits = np.zeros(1 << _CELL_BITS, bool)
                bits[found[1:][found[1:] == found[:-1]] >> np.uint32(32 - _CELL_BITS)] = True
                cells.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(cells, pa.binary())], ["bucket", "cells"])

    by_bucket = docs.mapInArrow(run, "bucket int, hashes binary").groupBy("bucket").agg(F.collect_list("hashes").alias("hashes"))
    bitmap = np.zeros((1 << _BUCKET_BITS, 1 << (_CELL_BITS - 3)), np.uint8)
    with _freed_shuffles(docs):
        found = by_bucket.mapInArrow(several, "bucket int, cells binary").toArrow()  # 16 MB at most
    for bucket, cells in zip(found.column("bucket").to_pylist(), found.column("cells").to_pylist()):
        bitmap[bucket] = np.frombuffer(cells, np.uint8)
    return bitmap.reshape(-1)


def seeds(docs: DataFrame, rules: PassageRules, cells: Broadcast | None, *, once: bool = False) -> DataFrame:
    """(h, doc, pos) of the runs of ``k`` words of ``docs`` (doc, text) that ``cells`` let through: all
    of them, or with ``once`` the first of each in a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, sizes = runs_of_all(as_bytes(batch.column("text")), rules.k)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
            if cells is not None:
                cell = h >> np.uint64(64 - _BUCKET_BITS - _CELL_BITS)
                bits = cells.value[(cell >> np.uint64(3)).astype(np.int64)] << (cell & np.uint64(7)).astype(np.uint8)
                kept = np.nonzero(bits & 128)[0]
                h, row, pos = h[kept], row[kept], pos[kept]
            if once:
                cuts = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
                kept = [np.unique(h[a:b], return_index=True)[1] + a for a, b in zip(cuts, cuts[1:]) if b > a]
                kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                h, row, pos = h[kept], row[kept], pos[kept]
            columns = [h.view(np.int64), batch.column("doc").to_numpy(zero_copy_only=False)[row], pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc", "pos"])

    return docs.mapInArrow(run, "h bigint, doc bigint, pos int")


_HOT_SHARE = 1000
# Rows of a task that a hash join may hold (tens of bytes each); more are joined by sorting.
_HASHED_ROWS = 1 << 20


def _with_first(rows: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``firsts``, one row per ``key`` with the number ``n`` of its holders.

    Keys with more than a thousandth of all holders, fewer than a thousand of them, are dealt to as
    many tasks as there are shuffle partitions, so that no task gets all rows of a common one.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, count = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("n") * _HOT_SHARE > F.lit(total)
    hot = firsts.where(often).select(key, F.lit(True).alias("hot"))  # fewer than a thousand rows
    dealt, by = firsts.drop("n"), [key]
    if not hot.isEmpty():
        salts = F.when(often, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
        dealt, by = firsts.withColumn("salt", F.explode(salts)).drop("n"), [key, "salt"]
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")).otherwise(F.lit(0))
        rows = rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("hot")
    if count <= spread * _HASHED_ROWS:
        dealt = dealt.hint("shuffle_hash")
    return rows.join(dealt, by).drop("salt")


class _PrefixMax:
    """Fenwick tree: largest (value, owner) among the first places."""

    def __init__(self, n: int):
        self.value, self.owner = [0.0] * (n + 1), [-1] * (n + 1)

    def best(self, upto: int) -> tuple[float, int]:
        top, who = 0.0, -1
        while upto:
            if self.value[upto] > top:
                top, who = self.value[upto], self.owner[upto]
            upto &= upto - 1
        return top, who

    def put(self, place: int, value: float, owner: int) -> None:
        n = len(self.value)
        while place < n:
            if value > self.value[place]:
                self.value[place], self.owner[place] = value, owner
            place += place & -place


def chains(pos: np.ndarray, other: np.ndarray, max_gap: int) -> list[np.ndarray]:
    """Indices of matches (pos in the document, pos in the other) that stand in one order.

    A chain scores one per match less a cost for every word skipped on either side; the best
    predecessor of a match is the largest entry of a Fenwick tree over the other document's
    positions, to which the cost already paid is added back. Chains are taken from the best
    end down, each match once, and cut where they skip more than ``max_gap`` words.
    """
    order = np.lexsort((-other, pos))
    x, y = pos[order].tolist(), other[order].tolist()
    place = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    tree, cost = _PrefixMax(len(place)), 1 / (2 * max_gap)
    score, before = [0.0] * len(x), [-1] * len(x)
    for i, (a, b) in enumerate(zip(x, y)):
        top, who = tree.best(place[b] - 1)
        gained = top - cost * (a + b)
        score[i] = 1.0
        if who >= 0 and gained > 0:
            score[i], before[i] = 1.0 + gained, who
        tree.put(place[b], score[i] + cost * (a + b), i)
    used, found = [False] * len(x), []
    for i in sorted(range(len(x)), key=score.__getitem__, reverse=True):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        path.reverse()
        start = 0
        for j in range(1, len(path) + 1):
            if j == len(path) or x[path[j]] - x[path[j - 1]] > max_gap or y[path[j]] - y[path[j - 1]] > max_gap:
                if j > start:
                    found.append(order[path[start:j]])
                start = j
    return found


def _breaks(row: np.ndarray, other: np.ndarray, pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the stretches, with the end: neighbouring places of a row that point at neighbouring places."""
    going_on = (np.diff(pos) == 1) & (np.diff(at) == 1) & (np.diff(other) == 0) & (np.diff(row) == 0)
    return np.concatenate(([0], np.nonzero(~going_on)[0] + 1, [len(pos)]))


def unsettled_runs(
    row: np.ndarray, h: np.ndarray, pos: np.ndarray, stretch: np.ndarray, rules: PassageRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, position) of the runs of ``min_words`` words whose seeds are all shared, but whose seeds'
    first places do not stand in one stretch. Both depend on the words alone, so whoever holds such
    a run lists it.
    """
    span = rules.min_words - rules.k
    n = len(pos) - span
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    at = np.nonzero((pos[span:] - pos[:n] == span) & (stretch[span:] != stretch[:n]) & (row[span:] == row[:n]))[0]
    keys, seed = np.zeros(len(at), np.uint64), h.astype(np.int64).view(np.uint64)
    for i in sorted({*range(0, span, rules.k), span}):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys += seed[at + i]
    return row[at], _mix(keys).view(np.int64), pos[at]


def junctions(
    row: np.ndarray, pos: np.ndarray, other: np.ndarray, at: np.ndarray, starts: np.ndarray, rules: PassageRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, places, offset) where a part that first stands in one document meets one of another.

    A part is a diagonal of matches: one other document, one difference of positions, no gap above
    ``max_gap``. The key is made of both documents and of how far the two differences lie apart, so
    it is that of whoever holds the two parts in this order at this distance, whichever of their
    words are replaced. Places are the first and last seed of both parts; the offset is the
    first part's difference. ``starts`` are those of the stretches, of which diagonals are made.
    """
    begin, end = starts[:-1], starts[1:] - 1
    r, o, p, q = row[begin], other[begin], pos[begin].astype(np.int64), pos[end].astype(np.int64)
    d = p - at[begin]
    order = np.lexsort((p, d, o, r))
    r, o, d, p, q = r[order], o[order], d[order], p[order], q[order]
    cuts = np.nonzero((np.diff(r) != 0) | (np.diff(o) != 0) | (np.diff(d) != 0) | (p[1:] - q[:-1] > rules.max_gap))[0] + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(p)])) - 1
    spans = q[last] - p[first] + rules.k >= rules.least_part
    first, last = first[spans], last[spans]
    order = np.lexsort((p[first], r[first]))
    first, last = first[order], last[order]
    a, b = slice(None, -1), slice(1, None)
    meet = (r[first[a]] == r[first[b]]) & (o[first[a]] != o[first[b]])
    meet &= (p[first[b]] - q[last[a]] <= rules.max_gap) & (q[last[b]] > q[last[a]])
    i, j = np.nonzero(meet)[0], np.nonzero(meet)[0] + 1
    keys = o[first[i]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = _mix(keys + o[first[j]].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    keys = _mix(keys + (d[first[j]] - d[first[i]]).view(np.uint64))
    places = np.stack([p[first[i]], q[last[i]], p[first[j]], q[last[j]]], axis=1).astype(np.int32)
    return r[first[i]], keys.view(np.int64), places, d[first[i]].astype(np.int32)


# Candidate links have no key; runs and junctions looked up by key have no other, and only junctions have places.
_LINKS = "doc bigint, other bigint, pos array<int>, other_pos array<int>, key bigint, at int"


def _chain_documents(matches: DataFrame, rules: PassageRules) -> DataFrame:
    """(doc, other, pos, other_pos): chains that may reach ``min_words`` and equal runs that do; and
    (doc, key, at): runs that first places of seeds do not settle; and (doc, key, pos, at): junctions.
    """
    least = rules.min_words - 2 * (rules.k + rules.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int], list[int]]] = []
            column, docs = batch.column("matches"), batch.column("doc").to_numpy()
            cuts, flat = column.offsets.to_numpy(), column.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(docs)), np.diff(cuts))
            columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            # Rows stay where they are; the places of each are put in order.
            order = np.lexsort((columns[1], row))
            h, pos, other, at = (c[order] for c in columns)
            starts = _breaks(row, other, pos, at)
            stretch = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            holder, key, place = unsettled_runs(row, h, pos, stretch, rules)
            meeting, joint, four, offset = junctions(row, pos, other, at, starts, rules)
            own = docs[row]
            first, last = starts[:-1], starts[1:] - 1
            equal = (last - first + rules.k >= rules.min_words) & (other[first] != own[first])
            for a, b in zip(first[equal].tolist(), last[equal].tolist()):
                out.append((int(own[a]), int(other[a]), [int(pos[a]), int(pos[b])], [int(at[a]), int(at[b])]))
            # Of a stretch every fourth place and the last are enough for chains.
            ends = np.zeros(len(pos), bool)
            ends[last] = True
            some = (((np.arange(len(pos)) - starts[stretch]) % 4 == 0) | ends) & (other != own)
            row, pos, other, at = row[some], pos[some], other[some], at[some]
            order = np.lexsort((other, row))
            row, pos, other, at = row[order], pos[order], other[order], at[order]
            edges = np.nonzero((np.diff(row, prepend=-1) != 0) | (np.diff(other, prepend=0) != 0))[0]
            upto = np.append(edges[1:], len(row))
            wide = (upto - edges >= 2) & (pos[upto - 1] - pos[edges] + rules.k >= least) if len(row) else slice(0)
            for a, b in zip(edges[wide].tolist(), upto[wide].tolist()):
                x, y = pos[a:b], at[a:b]
                for chained in chains(x, y, rules.max_gap):
                    if x[chained[-1]] - x[chained[0]] + rules.k >= least:
                        out.append((int(docs[row[a]]), int(other[a]), x[chained].tolist(), y[chained].tolist()))
            keys, holders = [key, joint], [docs[holder], docs[meeting]]
            places, ends_of = [place, offset], [None] * len(key) + four.tolist()
            more = len(ends_of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array([r[0] for r in out], np.int64), *holders])),
                    pa.array([r[1] for r in out] + [None] * more, pa.int64()),
                    pa.array([r[2] for r in out] + ends_of, pa.list_(pa.int32())),
                    pa.array([r[3] for r in out] + [None] * more, pa.list_(pa.int32())),
                    pa.concat_arrays([pa.nulls(len(out), pa.int64()), *map(pa.array, keys)]),
                    pa.concat_arrays([pa.nulls(len(out), pa.int32()), *map(pa.array, places)]),
                ],
                [c.split()[0] for c in _LINKS.split(", ")],
            )

    return matches.mapInArrow(run, _LINKS)


def covering(spans: list[tuple[int, int]]) -> list[int]:
    """Indices of few spans that cover what all (start, end), sorted by start, cover together."""
    chosen, upto, best = [], -1, -1
    for i, (start, end) in enumerate(spans):
        if start > upto and best >= 0:
            chosen.append(best)
            upto, best = spans[best][1], -1
        if end > upto and (best < 0 or end > spans[best][1]):
            if start > upto and best < 0:
                upto = start
            best = i
    return [*chosen, best] if best >= 0 else chosen


def _equal_runs(runs: DataFrame, rules: PassageRules) -> DataFrame:
    """(doc, other, pos, other_pos) of runs (doc, key, at) that an earlier document holds: at the
    first place of the whole run, so no part of it that stands elsewhere gets in the way.
    """
    shared = runs.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("first.doc < last").select("key", "n", F.col("first.doc").alias("other"), F.col("first.at").alias("other_at"))
    by_doc = _with_first(runs, materialise(shared, "first-runs"), "key").where("doc <> other").groupBy("doc")
    by_doc = by_doc.agg(F.collect_list(F.struct("at", "other", "other_at")).alias("matches"))
    span = rules.min_words - rules.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int], list[int]]] = []
            column = batch.column("matches")
            cuts, flat = column.offsets.to_numpy(), column.values
            columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for doc, i, j in zip(batch.column("doc").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                order = np.argsort(columns[0][i:j], kind="stable") + i
                at, other, place = (c[order] for c in columns)
                starts = _breaks(np.zeros_like(at), other, at, place)
                first, last = starts[:-1], starts[1:] - 1
                chosen = covering(list(zip(at[first].tolist(), (at[last] + rules.min_words).tolist())))
                for a, b in zip(first[chosen].tolist(), last[chosen].tolist()):
                    out.append((doc, int(other[a]), [int(at[a]), int(at[b]) + span], [int(place[a]), int(place[b]) + span]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "other", "pos", "other_pos"])

    return by_doc.mapInArrow(run, "doc bigint, other bigint, pos array<int>, other_pos array<int>")


def _joined_parts(found: DataFrame, rules: PassageRules) -> DataFrame:
    """(doc, other, pos, other_pos) of junctions (doc, key, pos, at) that an earlier document has: the ends
    of what both hold of either part, at the first document with the junction.
    """
    shared = found.groupBy("key").agg(F.min(F.struct("doc", "at", "pos")).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("first.doc < last").select(
        "key", "n", F.col("first.doc").alias("other"), F.col("first.at").alias("other_at"), F.col("first.pos").alias("ends")
    )
    both = _with_first(found, materialise(shared, "first-junctions"), "key").where("doc <> other")
    shift = F.col("at") - F.col("other_at")
    a, c = (F.greatest(F.col("pos")[i], F.col("ends")[i] + shift) for i in (0, 2))
    b, d = (F.least(F.col("pos")[i], F.col("ends")[i] + shift) for i in (1, 3))
    held = both.where((a <= b) & (c <= d)).select("doc", "other", F.array_sort(F.array_distinct(F.array(a, b, c, d))).alias("pos"), shift.alias("shift"))
    return held.select("doc", "other", "pos", F.transform("pos", lambda p: p - F.col("shift")).alias("other_pos"))


def _common(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for word in a:
        left = 0
        for j, also in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if word == also else max(up, row[j - 1])
            left = up
    return row[-1]


def _reach(a: Sequence[bytes], i: int, b: Sequence[bytes], j: int, step: int) -> tuple[int, int]:
    """How far the match goes on from (i, j): (words, matching words). Other words cost three."""
    score = best = n = matching = 0
    reached = (0, 0)
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - 10:
        n += 1
        if a[i] == b[j]:
            score, matching = score + 1, matching + 1
            if score > best:
                best, reached = score, (n, matching)
        else:
            score -= 3
        i, j = i + step, j + step
    return reached


def align(words: Sequence[bytes], other: Sequence[bytes], pos: Sequence[int], at: Sequence[int], k: int, max_gap: int = 30) -> tuple[int, int, int, int, int]:
    """Align a chain: (start, end, start in the other, its end, matching words).

    Seeds are equal runs; what lies between two of them is aligned by its longest common
    subsequence, and the ends are extended word by word. Chains have no gap above ``max_gap``; what is
    longer is a part of one diagonal, whose ends alone are named, and is compared place by place.
    """
    start, a_start = pos[0], at[0]
    end, a_end, matching = start, a_start, 0
    for x, y in zip(pos, at):
        skip = max(0, end - x, a_end - y)
        if skip >= k:
            continue
        x, y = x + skip, y + skip
        gap, a_gap = words[end:x], other[a_end:y]
        if gap == a_gap:
            matching += len(gap)
        elif len(gap) == len(a_gap) > max_gap:
            matching += sum(map(bytes.__eq__, gap, a_gap))
        else:
            matching += _common(gap, a_gap)
        end, a_end = x + k - skip, y + k - skip
        matching += sum(map(bytes.__eq__, words[x:end], other[y:a_end]))
    n, same = _reach(words, start - 1, other, a_start - 1, -1)
    start, a_start, matching = start - n, a_start - n, matching + same
    n, same = _reach(words, end, other, a_end, 1)
    return start, end + n, a_start, a_end + n, matching + same


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("bit")


def _members(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with one set for each id; its size does not depend on the data."""
    cells = ids.select(_bit(bits)).distinct().groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("members")
    )
    found = cells.toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, np.int64)
    words[found.column("cell").to_numpy()] = found.column("members").to_numpy()
    return words


def _holding(docs: DataFrame, members: np.ndarray, bits: int) -> DataFrame:
    """The documents that may be members."""
    held = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            mask = (held.value[at >> 6] >> (at & 63)) & 1
            yield batch.select(["doc", "text"]).filter(pa.array(mask.astype(bool)))

    return docs.select("doc", "text", _bit(bits)).mapInArrow(run, "doc bigint, text string")


_PASSAGE = "other bigint, start int, n_words int, other_start int, other_words int, matching int"


def repeated_passages(
    docs: DataFrame, rules: PassageRules = PassageRules(), *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Passages that an earlier document holds too: one row per document that has any.

    Columns: ``doc_id``, ``passages`` (array of ``other``: the earlier document, ``start`` and
    ``n_words`` here, ``other_start`` and ``other_words`` there, in words from 0, ``matching``
    words) and ``left_text``, the text without them. The first document that holds a passage
    keeps it. Repeats within one document are left alone. Null and short texts hold nothing.
    Rows whose id is null or occurs more than once cannot be told apart: they are no one's
    earlier document and lose nothing. Other columns are not read.

    Every seed points at its first place, the minimum over all places, so the number of
    matches is that of the places however many documents share a passage. Runs of ``min_words``
    words whose seeds are all shared but do not point at one stretch (put together from parts that
    stand elsewhere, or of few distinct words) point as a whole at their first place, so every
    equal run of ``min_words`` words is found. Where two parts meet that first stand in different
    documents, the junction points at the first document that has it, so edited passages put
    together from such parts are aligned with that one too.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    repeated = materialise(repeated, "repeated-ids")
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not repeated.isEmpty():
        rows = rows.join(repeated, "doc", "left_anti")
    cells = None
    if size[1] <= _BITMAP_TEXT_BYTES:
        cells = docs.sparkSession.sparkContext.broadcast(_shared_cells(rows, rules))
    with _freed_shuffles(docs):
        # The first place of a run: smallest document, and its first there. Aggregated before the shuffle.
        firsts = seeds(rows, rules, cells, once=True).groupBy("h").agg(
            F.min("doc").alias("other"), F.min_by("pos", "doc").alias("other_pos"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")
        )
        firsts = materialise(firsts.where("other < last").drop("last"), "first-places")
        # Written, so that the seeds' shuffle is gone before the one by document. Half a hash tells a document's runs apart.
        matches = _with_first(seeds(rows, rules, cells), firsts, "h").withColumn("h", F.shiftright("h", 32).cast("int"))
        matches = materialise(matches.select("doc", "h", "pos", "other", "other_pos"), "matches")
        by_doc = matches.groupBy("doc").agg(F.collect_list(F.struct("h", "pos", "other", "other_pos")).alias("matches"))
        links = materialise(_chain_documents(by_doc, rules), "chains")
    runs = links.where("key is not null and pos is null").select("doc", "key", "at")
    meeting = links.where("key is not null and pos is not null").select("doc", "key", "pos", "at")
    linked = links.where("key is null").select("doc", "other", "pos", "other_pos")
    linked = linked.union(materialise(_equal_runs(runs, rules), "equal-runs"))
    linked = linked.union(materialise(_joined_parts(meeting, rules), "joined-parts"))

    ids = linked.select("doc").union(linked.select(F.col("other").alias("doc")))
    bits = min(rules.filter_bits, max(1 << 16, 8 << int(size[0]).bit_length()))
    texts = materialise(_holding(rows, _members(ids, bits), bits), "passage-texts")
    anchored = linked.join(texts.withColumnRenamed("doc", "other"), "other")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            froms, parts = [], []
            for other, raw, at in zip(
                batch.column("other").to_pylist(), as_bytes(batch.column("text")), batch.column("other_pos").to_pylist()
            ):
                if other != last:
                    last, words = other, raw.lower().split()
                begin = max(0, at[0] - rules.margin)
                froms.append(begin)
                parts.append(b" ".join(words[begin : at[-1] + rules.k + rules.margin]).decode())
            columns = [batch.column(c) for c in ("doc", "other", "pos", "other_pos")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(froms, pa.int32()), pa.array(parts)], ["doc", "other", "pos", "other_pos", "begin", "part"]
            )

    parts = anchored.select("doc", "other", "pos", "other_pos", "text").mapInArrow(
        cut, "doc bigint, other bigint, pos array<int>, other_pos array<int>, begin int, part string"
    )
    # A document's chains are made of its own seeds, so what is gathered is bounded by its length.
    by_doc = parts.groupBy("doc").agg(F.collect_list(F.struct("other", "pos", "other_pos", "begin", "part")).alias("chains"))
    held = texts.join(by_doc, "doc")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, left = [], [], []
            for doc, raw, own in zip(
                batch.column("doc").to_pylist(), as_bytes(batch.column("text")), batch.column("chains").to_pylist()
            ):
                passages = _verified(raw, own, rules)
                if passages:
                    ids.append(doc)
                    lists.append(passages)
                    left.append(without(raw, [(p["start"], p["n_words"]) for p in passages]).decode())
            kind = pa.list_(pa.struct([(c.split()[0], pa.int64() if "bigint" in c else pa.int32()) for c in _PASSAGE.split(", ")]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, kind), pa.array(left, pa.string())], ["doc", "passages", "left_text"])

    schema = f"doc bigint, passages array<struct<{_PASSAGE.replace(' ', ': ').replace(',:', ',')}>>, left_text string"
    result = held.select("doc", "text", "chains").mapInArrow(finish, schema)
    return result.withColumnRenamed("doc", doc_id)


def _verified(raw: bytes, own: list[dict], rules: PassageRules) -> list[dict]:
    words, found = raw.lower().split(), []
    for chain in own:
        at, pos, part = [p - chain["begin"] for p in chain["other_pos"]], chain["pos"], chain["part"].encode().split()
        aligned = [align(words, part, pos, at, rules.k, rules.max_gap)]
        n = pos[-1] + rules.k - pos[0]
        if words[pos[0] : pos[0] + n] == part[at[0] : at[-1] + rules.k]:
            # What follows an equal run must not cost it.
            aligned.append((pos[0], pos[0] + n, at[0], at[0] + n, n))
        for start, end, a_start, a_end, matching in aligned:
            if end - start >= rules.min_words and matching >= rules.identity * max(end - start, a_end - a_start):
                found.append({
                    "other": chain["other"], "start": start, "n_words": end - start,
                    "other_start": a_start + chain["begin"], "other_words": a_end - a_start, "matching": matching,
                })
                break
    # An equal run is often part of a chain; each passage is named once.
    kept, reached = [], {}
    for p in sorted(found, key=lambda p: (p["start"], -p["n_words"], p["other"], p["other_start"])):
        if p["start"] + p["n_words"] > reached.get(p["other"], 0):
            kept.append(p)
            reached[p["other"]] = p["start"] + p["n_words"]
    return sorted(kept, key=lambda p: (p["start"], p["other"], p["n_words"]))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less runs of words, each with the white space that follows it."""
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for start, n in sorted(spans):
        begin, end = places[start], places[start + n]
        if begin > at:
            out.append(raw[at:begin])
        at = max(at, end)
    return b"".join([*out, raw[at:]])


def remove_passages(
    docs: DataFrame,
    rules: PassageRules = PassageRules(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    chars: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``chars`` counted anew.

    Documents of which nothing but white space is left go; all others stay, in their columns,
    whatever these are named.
    """
    doc, left = unused("doc", docs), unused("left_text", docs)
    found = repeated_passages(docs, rules, doc_id=doc_id, text=text).select(
        F.col(doc_id).cast("bigint").alias(doc), F.col("left_text").alias(left)
    )
    found = materialise(found, "left-texts")
    joined = docs.join(found, F.col(f"`{doc_id}`").cast("bigint") == F.col(doc), "left")
    new = F.coalesce(left, f"`{text}`")
    counted = F.when(F.col(left).isNotNull(), F.length(left)).otherwise(F.col(f"`{chars}`")) if chars else None
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(new.alias(c))
        elif c == chars:
            columns.append(counted.cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return joined.where(F.col(left).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]")).select(*columns)
