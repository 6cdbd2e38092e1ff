"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokenize import class_table, load_table, pieces, read_ranks
from .texts import narrow, slices

# Pieces whose ids each Python worker remembers, and ids that these may have; beyond that the cache
# starts anew. It only saves work.
CACHE_PIECES = 150_000
_HELD_IDS = 8 * CACHE_PIECES


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: neighbouring parts are merged in order of rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    none, get = len(ranks) + 1, ranks.get
    cuts = list(range(len(piece) + 1))
    found = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while found:
        best = min(found)
        if best == none:
            break
        i = found.index(best)
        del cuts[i + 1], found[i]
        if i < len(found):
            found[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            found[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return tuple([ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a long piece, with a heap, so that its cost does not grow with the square."""
    from heapq import heapify, heappop, heappush

    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] == n or end[i] >= stop or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := get(piece[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.uint64(np.iinfo(np.uint64).max)
# Pieces merged side by side have fewer bytes than this; a place in one takes so many bits.
_SHORT, _PLACE_BITS = 64, 6
# Widths that pieces are padded to, and pieces merged at a time.
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, _SHORT - 1)
_SIDE_BY_SIDE = 4096
# Strings whose bytes are gathered at a time; a gathered byte takes two places in arrays of numbers.
_JOINED_AT_ONCE = 1 << 17


def gathered(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` by number, one after the other, and where each begins, with the end.

    Stretch i goes from ``ends[i]`` to ``ends[i + 1]``.
    """
    begins = ends[numbers]
    sizes = ends[numbers + 1] - begins
    upto = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])], upto


class Strings:
    """Byte strings by number, put together without a step of Python for each."""

    def __init__(self, strings: Sequence[bytes]):
        self.values = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))))

    def joined(self, numbers: Sequence[int], upto: Sequence[int]) -> list[bytes]:
        """The joined strings of numbers up to each place, from the one before."""
        numbers, parts = np.asarray(numbers, np.int64), []
        for k in range(0, len(numbers), _JOINED_AT_ONCE):
            values, _ = gathered(self.values, self.ends, numbers[k : k + _JOINED_AT_ONCE])
            parts.append(values.tobytes())
        whole = b"".join(parts)
        ends = np.concatenate(([0], np.cumsum(self.ends[numbers + 1] - self.ends[numbers])))
        cuts = ends[np.asarray(upto, np.int64)].tolist()
        return [whole[i:j] for i, j in zip([0, *cuts], cuts)]


class Pairs:
    """A hash table from two neighbouring ids to the id of both, probed for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        get, self.base = ranks.get, np.uint64(max(ranks.values(), default=0) + 2)
        halves = ((get(t[:i]), get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
        both = np.array([h for h in halves if h[0] is not None and h[1] is not None], np.uint64).reshape(-1, 3)
        bits = max(4, (4 * len(both)).bit_length())
        self.last, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.ids = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE)
        keys, ids = both[:, 0] * self.base + both[:, 1], both[:, 2].astype(np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.nonzero(self.keys[slots] == _EMPTY)[0]
            free = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[free]], self.ids[slots[free]] = keys[free], ids[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            keys, ids, slots = keys[left], ids[left], slots[left] + np.uint64(1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair, ``_NONE`` for pairs that are no token."""
        keys = left.astype(np.uint64) * self.base + right.astype(np.uint64)
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.ids[slots], _NONE)
        at = np.nonzero((there != keys) & (there != _EMPTY))[0]
        slots = slots[at]
        while len(at):
            slots = slots + np.uint64(1) & self.last
            there, wanted = self.keys[slots], keys[at]
            hit = there == wanted
            found[at[hit]] = self.ids[slots[hit]]
            going = ~hit & (there != _EMPTY)
            at, slots = at[going], slots[going]
        return found


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], packed_classes: bytes):
        self.ranks = ranks
        self.classes = load_table(packed_classes)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, number in ranks.items():
            self.bytes_of[number] = token
        self.tokens = Strings(self.bytes_of)
        self.decimals = Strings([b"%d," % i for i in range(len(self.bytes_of))])
        single = [ranks.get(bytes([i])) for i in range(256)]
        self.pairs = None
        if None not in single and len(self.bytes_of) < 1 << (30 - _PLACE_BITS):
            self.pairs, self.single = Pairs(ranks), np.array(single, np.int32)
        self.forget()

    def forget(self) -> None:
        """Start the cache anew: the number of each piece, and where its ids end among all ids held."""
        self.number_of: dict[str, int] = {}
        self.held, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge_all(self, raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) of pieces of at least two bytes and fewer than ``_SHORT``.

        All pieces take a step at a time: each merges its pair of the lowest rank, the leftmost of
        these. Rows are places, columns pieces; a place that has been merged into the one before
        holds no id. ``order`` is rank and place of the pair that starts at a place.
        """
        width, n = len(max(raws, key=len)), len(raws)
        nothing = np.int32(len(self.bytes_of))
        sizes = np.fromiter(map(len, raws), np.int64, n)
        piece = np.repeat(np.arange(n), sizes)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, cell = self.single[np.frombuffer(b"".join(raws), np.uint8)], place * n + piece
        # The last row stands for what is before and after a piece.
        ids, order = np.full((width + 1) * n, nothing), np.full((width + 1) * n, _NONE)
        ids[cell] = one
        both = np.nonzero(piece[1:] == piece[:-1])[0]
        rank = self.pairs.of(one[both], one[both + 1])
        both, rank = both[rank != _NONE], rank[rank != _NONE]
        order[cell[both]] = rank << _PLACE_BITS | place[both]
        after = np.arange(n, (width + 2) * n)
        before = after - 2 * n
        before[:n] += (width + 1) * n
        while True:
            best = order.reshape(width + 1, n).min(axis=0)
            at = np.nonzero(best != _NONE)[0]
            if not len(at):
                break
            best = best[at]
            rank, here = best >> _PLACE_BITS, (best & (_SHORT - 1)) * n + at
            gone, leading = after[here], before[here]
            following = after[gone]
            ids[here], ids[gone], order[gone] = rank, nothing, _NONE
            after[here], before[following] = following, here
            new = self.pairs.of(np.concatenate((rank, ids[leading])), np.concatenate((ids[following], rank)))
            starts = np.concatenate((here, leading))
            order[starts] = np.where(new == _NONE, _NONE, new << _PLACE_BITS | starts // n)
        by_piece = np.ascontiguousarray(ids.reshape(width + 1, n)[:width].T)
        kept = by_piece != nothing
        return by_piece[kept], kept.sum(axis=1)

    def learn(self, new: Sequence[str]) -> None:
        """Add distinct pieces to the cache."""
        raws = [piece.encode() for piece in new]
        whole = list(map(self.ranks.get, raws))
        split = [i for i, rank in enumerate(whole) if rank is None]
        sizes = np.fromiter((len(raws[i]) for i in split), np.int64, len(split))
        order = np.argsort(sizes, kind="stable")
        # One byte that is no token, or all if the table of pairs cannot be used, go the plain way.
        cuts = np.searchsorted(sizes[order], [2, *(w + 1 for w in _WIDTHS)]) if self.pairs else [0] * (len(_WIDTHS) + 1)
        split = [split[i] for i in order.tolist()]
        named = [i for i, rank in enumerate(whole) if rank is not None]
        found = [np.array([whole[i] for i in named], np.int32)]
        counts = [np.ones(len(named), np.int64)]
        for i in (*split[: cuts[0]], *split[cuts[-1] :]):
            ids = merge(raws[i], self.ranks) if len(raws[i]) < 200 else merge_long(raws[i], self.ranks)
            named.append(i)
            found.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)], np.int64))
        for begin, end in zip(cuts, cuts[1:]):
            for k in range(begin, end, _SIDE_BY_SIDE):
                some = split[k : min(end, k + _SIDE_BY_SIDE)]
                ids, n = self.merge_all([raws[i] for i in some])
                named += some
                found.append(ids)
                counts.append(n)
        begin = len(self.number_of)
        self.number_of.update(zip([new[i] for i in named], range(begin, begin + len(named))))
        self.held = np.concatenate((self.held, *found))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))))

    def encode_array(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids up to the end of each text."""
        cut, upto = pieces(texts, self.classes)
        if len(self.number_of) >= CACHE_PIECES or len(self.held) >= _HELD_IDS:
            self.forget()
        numbers = np.fromiter(map(self.number_of.get, cut, repeat(-1)), np.int64, len(cut))
        missing = np.nonzero(numbers < 0)[0]
        if len(missing):
            lacking = [cut[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(lacking)))
            numbers[missing] = np.fromiter(map(self.number_of.__getitem__, lacking), np.int64, len(lacking))
        ids, ends = gathered(self.held, self.ends, numbers)
        return ids, ends[upto]

    def encode(self, texts: Sequence[str]) -> tuple[list[int], np.ndarray]:
        ids, upto = self.encode_array(texts)
        return ids.tolist(), upto

    def decode(self, ids: Sequence[int], upto: Sequence[int]) -> list[bytes]:
        """Bytes of each text: those of all ids, cut at the offsets kept from encoding."""
        return self.tokens.joined(ids, upto)


_codecs: dict[str, Codec] = {}


def codec(path: str, packed_classes: bytes) -> Codec:
    """The codec of this worker; the vocabulary file is installed on every machine."""
    if path not in _codecs:
        _codecs[path] = Codec(read_ranks(path), packed_classes)
    return _codecs[path]


def encode_documents(
    docs: DataFrame, ranks_path: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Token ids of every whole text, and what they decode to: one row per input row.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded bytes) and, if asked for, ``ids``. A null text counts as
    empty: no ids, digests of nothing. Nulls and repeats of doc_id pass through; other columns
    are not read.
    """
    rows = narrow(docs, text=text, doc_id=doc_id)
    classes = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(ranks_path, classes)
        for batch in slices(batches, text):
            ids, upto = worker.encode_array(batch.column(text).to_pylist())
            cuts = np.concatenate(([0], upto))
            columns = [
                batch.column(doc_id),
                pa.array(np.diff(cuts), pa.int64()),
                # Every decimal brings a comma; the last one goes.
                pa.array([hashlib.sha256(d[:-1]).hexdigest() for d in worker.decimals.joined(ids, upto)]),
                pa.array([hashlib.sha256(d).hexdigest() for d in worker.decode(ids, upto)]),
            ]
            names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{doc_id} {rows.schema[doc_id].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
