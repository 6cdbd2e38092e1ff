"""Alignment of two tokenizations of the same bytes, and counts of aligned ids over all documents.

Both tokenizers read space+text. Each token start is looked up among the other side's starts
(pandas merge_asof, keyed by the text): the token found covers it. Looked up both ways this
gives all overlaps; where two overlapping tokens end together, a group of tokens ends.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .frames import ChunkEncoder
from .pretokenize import class_table
from .texts import narrow, slices

# Runs of text whose pieces a worker remembers, and characters of text that it aligns at a time.
_CACHE_RUNS = 300_000
_UNIT_CHARS = 1 << 19
_BATCH_CHARS = 1 << 20
# Pairs of positions within one group that are written out before equal ids are counted.
_WIDE_GROUP = 4096
# Id pairs held by most documents, which are looked up in a broadcast table of at most this many rows.
MOST_HOT_PAIRS = 1 << 18
_BUCKETS_PER_DOUBLING = 8


class PieceEncoder:
    """Ids of a sentencepiece BPE model, remembered for each run of text between two spaces.

    No piece of a BPE model that was trained on words goes on after a space, so runs are
    encoded apart. The model is asked for that; if one does, or two spaces meet, the model
    encodes the text whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def encode(self, units: Sequence[str]) -> list[bytes]:
        """Ids of each unit, which starts with a space, as little-endian 32-bit numbers."""
        runs = [u[1:].split(" ") for u in units]
        whole = [i for i, r in enumerate(runs) if not self.apart or "" in r]
        found = [list(map(self.known.get, r)) for r in runs]
        new = {w for i, (r, f) in enumerate(zip(runs, found)) if None in f for w, ids in zip(r, f) if ids is None and w}
        if not self.apart:
            new = set()
        words = list(new)
        learned = dict(zip(words, self._packed(words))) if words else {}
        self.known.update((w, ids) for w, ids in learned.items() if len(w) < 64)
        if len(self.known) > _CACHE_RUNS:
            self.known = dict(islice(self.known.items(), _CACHE_RUNS // 2))
        alone = dict(zip(whole, self._packed([units[i][1:] for i in whole]))) if whole else {}
        out = []
        for i, (r, f) in enumerate(zip(runs, found)):
            if i in alone:
                out.append(alone[i])
                continue
            out.append(b"".join([learned[w] if ids is None else ids for w, ids in zip(r, f)] if None in f else f))
        return out


class ByteEncoder(ChunkEncoder):
    """Ids of a byte-level tokenizers file, with the bytes of each; strings of added tokens are plain text."""

    def __init__(self, path: str, packed_classes: bytes):
        super().__init__(path, packed_classes, added_tokens=False)
        raw_of = {c: b for b, c in self.shown.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            if all(c in raw_of for c in token):
                self.bytes_of[number] = bytes([raw_of[c] for c in token])


@dataclass
class Side:
    """Tokens of one side of a batch: ids, and where they start and end on a common axis of bytes."""

    ids: np.ndarray
    unit: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, packed: Sequence[bytes], sizes: np.ndarray) -> Side:
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(packed)), [len(p) // 4 for p in packed])
        end = np.cumsum(sizes[ids])
        return cls(ids, unit, end - sizes[ids], end)

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"at": self.start, "unit": self.unit, name: np.arange(len(self.ids))}, copy=False)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of overlapping tokens: those that cover a start of the other side, both ways."""
    left, right = a.frame("a"), b.frame("b")
    of_a = pd.merge_asof(left, right, on="at", by="unit")
    of_b = pd.merge_asof(right, left, on="at", by="unit")
    return (
        np.concatenate((of_a["a"].to_numpy(), of_b["a"].to_numpy())).astype(np.int64),
        np.concatenate((of_a["b"].to_numpy(), of_b["b"].to_numpy())).astype(np.int64),
    )


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group; a group ends where two overlapping tokens end together."""
    i, j = overlaps(a, b)
    together = a.end[i] == b.end[j]
    out = []
    for side, at in ((a, i), (b, j)):
        ends = np.zeros(len(side.ids), np.int64)
        ends[at[together]] = 1
        out.append(np.cumsum(ends) - ends)
    return out[0], out[1]


def linked(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens that share a group as (unit, code, times); code is a's id times ``width`` plus b's."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    p, q = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
    size = p * q
    wide = np.nonzero(size > _WIDE_GROUP)[0]
    size[wide] = 0
    of = np.repeat(np.arange(n), size)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at_a, at_b = first_a[of] + offset // q[of], first_b[of] + offset % q[of]
    units, codes, times = [a.unit[at_a]], [a.ids[at_a] * width + b.ids[at_b]], [np.ones(len(of), np.int64)]
    for g in wide.tolist():
        ids_a, n_a = np.unique(a.ids[first_a[g] : first_a[g] + p[g]], return_counts=True)
        ids_b, n_b = np.unique(b.ids[first_b[g] : first_b[g] + q[g]], return_counts=True)
        codes.append((ids_a[:, None] * width + ids_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        units.append(np.full(len(codes[-1]), a.unit[first_a[g]]))
    return np.concatenate(units), np.concatenate(codes), np.concatenate(times)


def added_up(unit: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (unit, code) as one, times added; in order of unit and code."""
    if not len(unit):
        return unit, code, times
    order = np.lexsort((code, unit))
    unit, code = unit[order], code[order]
    new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])))
    at = np.nonzero(new)[0]
    return unit[at], code[at], np.add.reduceat(times[order], at)


def shown(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, decimal: np.ndarray) -> list[str]:
    """Tokens in the form ``a1,a2|b1;a3|b2,b3;``, one string each, all groups of a batch in order."""
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    # The decimal table holds each id three times: before a comma, a bar and a semicolon.
    codes = np.empty(len(group_a) + len(group_b), np.int64)
    n = int(group_a[-1]) + 1
    p, q = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    # A token stands after all tokens of its side before it and all of the other side's earlier groups.
    codes[np.arange(len(group_a)) + (np.cumsum(q) - q)[group_a]] = a.ids * 3 + last_a
    codes[np.arange(len(group_b)) + np.cumsum(p)[group_b]] = b.ids * 3 + 2 * last_b
    return decimal[codes].tolist()


@dataclass
class Found:
    """What is known of one document while its units pass by."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    codes: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    good: bool = True


class Aligner:
    """Both encoders of one worker."""

    def __init__(self, byte_path: str, piece_path: str, packed_classes: bytes):
        self.a, self.b = ByteEncoder(byte_path, packed_classes), PieceEncoder(piece_path)
        self.width = len(self.b.bytes_of)
        self.sizes = [np.array(list(map(len, side.bytes_of)), np.int64) for side in (self.a, self.b)]
        longest = max(len(self.a.bytes_of), self.width)
        self.decimal = np.array([f"{i}{c}" for i in range(longest) for c in ",|;"], object)

    def units(self, text: str) -> Iterator[str]:
        """space+text, a long one in parts: both sides always cut before a space between letters or digits."""
        text, start = " " + text, 0
        while self.b.apart and len(text) - start > _UNIT_CHARS:
            end = start + _UNIT_CHARS
            while (end := text.find(" ", end)) > 0 and not (text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()):
                end += 1
            if end < 0:
                break
            yield text[start:end]
            start = end
        yield text[start:]

    def _same_bytes(self, units: Sequence[str], packed: Sequence[bytes], bytes_of: list[bytes]) -> list[bool]:
        get = bytes_of.__getitem__
        return [b"".join(map(get, np.frombuffer(p, "<u4").tolist())) == u.encode() for u, p in zip(units, packed)]

    def align(self, units: Sequence[str], of: Sequence[Found]) -> None:
        """Add what each unit holds to the document it is ``of``; units of a document come in order."""
        packed_a, packed_b = self.a.encode(units), self.b.encode(units)
        same = zip(
            self._same_bytes(units, packed_a, self.a.bytes_of), self._same_bytes(units, packed_b, self.b.bytes_of), of, strict=True
        )
        good = []
        for i, (same_a, same_b, document) in enumerate(same):
            document.good &= same_a and same_b
            if document.good:
                good.append(i)
        if not good:
            return
        of = [of[i] for i in good]
        a = Side.of([packed_a[i] for i in good], self.sizes[0])
        b = Side.of([packed_b[i] for i in good], self.sizes[1])
        group_a, group_b = groups(a, b)
        texts = shown(a, b, group_a, group_b, self.decimal)
        unit, code, times = added_up(*linked(a, b, group_a, group_b, self.width))
        marks = np.arange(len(of) + 1)
        cut_a, cut_b, cut = (np.searchsorted(x, marks).tolist() for x in (a.unit, b.unit, unit))
        for i, document in enumerate(of):
            n_a, n_b = cut_a[i + 1] - cut_a[i], cut_b[i + 1] - cut_b[i]
            own = "".join(texts[cut_a[i] + cut_b[i] : cut_a[i + 1] + cut_b[i + 1]])
            document.digest.update(((";" if document.n_a else "") + own[:-1]).encode())
            document.n_a += n_a
            document.n_b += n_b
            document.n_groups += int(group_a[cut_a[i + 1] - 1] - group_a[cut_a[i]]) + 1
            document.codes.append(code[cut[i] : cut[i + 1]])
            document.times.append(times[cut[i] : cut[i + 1]])


@lru_cache(2)
def _aligner(byte_path: str, piece_path: str, packed_classes: bytes) -> Aligner:
    return Aligner(byte_path, piece_path, packed_classes)


_ALIGNED = (
    "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<struct<code bigint, times bigint>>"
)


def _rows_of(ids: list, rows: list, documents: list[Found]) -> pa.RecordBatch:
    found = [d if d.good and d.n_a else None for d in documents]
    pairs = [_together(d) if d else _NO_PAIRS for d in found]
    structs = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[k] for p in pairs]), pa.int64()) for k in (0, 1)], ["code", "times"]
    )
    offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in pairs]))).astype(np.int32)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(rows, pa.int64()),
        *[pa.array([getattr(d, n) if d else 0 for d in found], pa.int64()) for n in ("n_a", "n_b", "n_groups")],
        pa.array([int(p[1].sum()) for p in pairs], pa.int64()),
        pa.array([d.digest.hexdigest() if d else "" for d in found], pa.string()),
        pa.ListArray.from_arrays(pa.array(offsets), structs),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


_NO_PAIRS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _together(document: Found) -> tuple[np.ndarray, np.ndarray]:
    if len(document.codes) == 1:
        return document.codes[0], document.times[0]
    code = np.concatenate(document.codes)
    _, code, times = added_up(np.zeros(len(code), np.int64), code, np.concatenate(document.times))
    return code, times


def align_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, int]:
    """Groups and links of every text, and the number that codes of id pairs are built with.

    Rows: ``doc_id``, ``row`` (a number of its own for each row), ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups_sha256``, ``pairs``: linked ids as (``code``, ``times``), where ``code`` is
    a's id times the number plus b's id.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    classes = class_table()
    rows = narrow(docs, text=text, doc_id=doc_id).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path, classes)
        gc.disable()  # many strings and no cycles; the collector would walk all of them again and again
        try:
            for batch in slices(batches, "text", _BATCH_CHARS):
                documents = [Found() for _ in range(batch.num_rows)]
                units, of, held = [], [], 0
                for value, document in zip(batch.column("text").to_pylist(), documents):
                    for unit in aligner.units(value) if value else ():
                        if held and held + len(unit) > _BATCH_CHARS:
                            aligner.align(units, of)
                            units, of, held = [], [], 0
                        units.append(unit)
                        of.append(document)
                        held += len(unit)
                if units:
                    aligner.align(units, of)
                yield _rows_of(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), documents)
        finally:
            gc.enable()

    return materialise(rows.mapInArrow(run, _ALIGNED), "aligned-tokens"), width


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """How many rows hold each linked id pair: ``code``, ``n``, ``best`` (highest of its a id, ties too)."""
    counts = aligned.select(F.inline("pairs")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy("a")  # at most as many rows as the other vocabulary has ids
    counts = counts.withColumn("a", F.expr(f"code div {int(width)}")).withColumn("best", F.col("n") == F.max("n").over(of_a))
    return materialise(counts.drop("a"), "pair-counts")


def _rare_below(counts: DataFrame, limit: int) -> tuple[int, int]:
    """The least bucket of counts so that pairs in it and above are at most ``limit``; and how many are below."""
    buckets = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("pairs")).collect()  # eight a doubling of the count
    cut, held, rest = 1 << 30, 0, sum(r["pairs"] for r in buckets)
    for r in sorted(buckets, key=lambda r: -r["bucket"]):
        if held + r["pairs"] > limit:
            break
        cut, held, rest = r["bucket"], held + r["pairs"], rest - r["pairs"]
    return cut, rest


def align_documents(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    most_hot: int = MOST_HOT_PAIRS,
) -> DataFrame:
    """Alignment of a byte-level tokenizer (a) with a sentencepiece BPE model (b), one row per input row.

    Columns: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (token pairs that share a
    group), ``n_best`` (links whose id pair stands in as many rows as any of its a id),
    ``count_sum`` (rows that hold the pair, added up over links), ``groups_sha256``. A null or empty
    text, and one whose tokens do not give its bytes back on either side, has zeros and no digest.
    Nulls and repeats of doc_id pass through, each row counting for itself; other columns are not
    read; an empty table gives an empty one.

    Pairs that most rows hold are looked up in a broadcast table of at most ``most_hot`` rows; the
    others, each held by few rows, in a shuffle join.
    """
    aligned, width = align_tokens(docs, byte_path, piece_path, doc_id=doc_id, text=text)
    bucket = F.floor(F.log2("n") * _BUCKETS_PER_DOUBLING).cast("int")
    counts = pair_counts(aligned, width).withColumn("bucket", bucket)
    cut, rest = _rare_below(counts, most_hot)
    hot = F.broadcast(counts.where(F.col("bucket") >= cut).drop("bucket"))
    links = aligned.select("row", F.inline("pairs"))
    told = links.join(hot, "code")
    if rest:
        rare = counts.where(F.col("bucket") < cut).drop("bucket")
        told = told.unionByName(links.join(hot.select("code"), "code", "left_anti").join(rare, "code").select(told.columns))
    sums = told.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_best", "count_sum")}
    return (
        aligned.drop("pairs")
        .join(sums, "row", "left")
        .withColumns(zero)
        .select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )
