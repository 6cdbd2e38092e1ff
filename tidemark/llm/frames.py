"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each with its own checksum and holding whole documents,
then a skippable frame with the directory and a skippable frame with the seek table of the
public seekable format. Anything that reads zstandard can read the frames in a row; a reader
that wants some documents reads the two tables at the end and only the frames that hold them.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, work_dir
from .pretokenize import class_table, load_table, pieces
from .texts import narrow, slices

# Fixed values of the zstandard seekable format.
_SEEK_FRAME = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_HAS_CHECKSUMS = 0x80
# A skippable frame for what the seekable format has no place for.
_DIRECTORY_FRAME = 0x184D2A50
_ENTRY = struct.Struct("<III")  # compressed size, decompressed size, checksum
_PLACE = struct.Struct("<QQ")  # documents and ids before the frame, in its file
_FOOTER = struct.Struct("<IBI")

FRAME_IDS = 1 << 18
END_ID = 2
# Runs of text remembered by a worker. When there is no more room those met last go: common words
# are met early.
CACHE_CHUNKS = 400_000
_CACHE_PIECES = 120_000
_NO_ID = -(1 << 63)


class ChunkEncoder:
    """Ids by a tokenizers file, remembered for each run of text between two single spaces.

    The tokenizer's pattern always cuts before a space that stands alone between two other
    characters, so such runs are encoded apart. A text with any other kind of space next to a
    space, or with the string of an added token, goes through the library whole. New runs are cut into the pieces of the pattern and
    merged by the library's own model.
    """

    def __init__(self, path: str, packed_classes: bytes, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # With ``added_tokens`` their strings in a text get their ids, as the library does by itself;
        # without, they are ordinary text.
        self.tokenizer.encode_special_tokens = not added_tokens
        found = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
        self.added = [t.content for t in found if t.content]
        model = self.tokenizer.model
        model._resize_cache(0)  # pieces are remembered here
        self.tokenize = model.tokenize
        self.classes = load_table(packed_classes)
        # Ids as little-endian 32-bit numbers, so that a text's ids are one join of bytes.
        self.packed = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        # Bytes as the characters that stand for them in a byte-level vocabulary.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.shown[ord(" ")]

    def _ids(self, mapped: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.tokenize(mapped)])

    def _merge(self, piece: str) -> bytes:
        body = piece[1:]
        if body.isascii() and body.isalpha() and (piece[0] == " " or piece[0].isascii() and piece[0].isalpha()):
            return self._ids(self.space + body if piece[0] == " " else piece)  # letters stand for themselves
        return self._ids(piece.encode().decode("latin-1").translate(self.shown))

    def _merge_once(self, piece: str) -> bytes:
        found = self.merged.get(piece)
        if found is None:
            found = self._merge(piece)
            if len(self.merged) >= _CACHE_PIECES:
                self.merged.clear()
            if len(piece) < 40:
                self.merged[piece] = found
        return found

    def _word(self, body: str) -> bytes:
        """Ids of a space and a word of plain letters, which as a run of its own is remembered already."""
        found = self.later.get(body)
        if found is None:
            found = self._ids(self.space + body)
            if len(body) < 64:
                self.later[body] = found
        return found

    def _learn(self, chunks: set[str], prefix: str, known: dict[str, bytes]) -> dict[str, bytes]:
        found, wanted = {}, []
        for c in chunks:
            # A word of plain letters is one piece; a full stop or comma after it another.
            if c.isascii():
                if c.isalpha():
                    found[c] = self._word(c) if prefix else self._merge_once(c)
                    continue
                if c[-1] in ".," and (body := c[:-1]).isalpha():
                    found[c] = (self._word(body) if prefix else self._merge_once(body)) + self._merge_once(c[-1])
                    continue
            wanted.append(c)
        cut, upto = pieces([prefix + c for c in wanted], self.classes)
        ids = list(map(self.merged.get, cut))
        for i in [i for i, known_ids in enumerate(ids) if known_ids is None]:
            ids[i] = self._merge_once(cut[i])
        start = 0
        for c, end in zip(wanted, upto.tolist()):
            found[c] = ids[start] if end == start + 1 else b"".join(ids[start:end])
            start = end
        known.update((c, raw) for c, raw in found.items() if len(c) < 64)
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        split = [t.split(" ") for t in texts]
        found = [list(map(self.later.get, words)) for words in split]
        missing, heads = [], set()
        for words, ids in zip(split, found):
            heads.add(words[0])
            ids[0] = b""
            missing.append(_places_of_none(ids))
        new = {words[i] for words, places in zip(split, missing) for i in places}
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        extra = self._learn(new - odd, " ", self.later)
        if len(self.later) > CACHE_CHUNKS:
            self.later = dict(islice(self.later.items(), CACHE_CHUNKS // 2))
        unknown = {w for w in heads if w and w not in self.first and not w[-1].isspace()}
        first = self._learn(unknown, "", {}) | {w: self.first[w] for w in heads if w in self.first}
        self.first.update((w, first[w]) for w in unknown if len(w) < 64 and len(self.first) < CACHE_CHUNKS // 8)
        out = []
        for text, words, ids, places in zip(texts, split, found, missing):
            if words[0]:
                ids[0] = first.get(words[0])
            if ids[0] is None or odd and any(words[i] in odd for i in places) or any(a in text for a in self.added):
                out.append(self._whole(text))
                continue
            for i in places:
                ids[i] = extra[words[i]]
            out.append(b"".join(ids))
        return out


def _places_of_none(found: list) -> list[int]:
    places, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            places.append(at)
    except ValueError:
        return places


@lru_cache(2)
def _encoder(path: str, packed_classes: bytes) -> ChunkEncoder:
    return ChunkEncoder(path, packed_classes, added_tokens=True)


class FrameWriter:
    """Writes documents into frames of about ``frame_ids`` ids."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 1):
        self.sink, self.frame_ids = sink, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries, self.places = [], []
        self.documents = self.ids = 0
        self._held: list[tuple[int, bytes]] = []
        self._size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian 32-bit numbers."""
        self._held.append((_NO_ID if doc_id is None else doc_id, ids))
        self._size += len(ids) // 4
        if self._size >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if not self._held:
            return
        head = struct.pack("<I", len(self._held)) + b"".join(struct.pack("<qQ", d, len(raw) // 4) for d, raw in self._held)
        payload = b"".join([head, *[raw for _, raw in self._held]])
        packed = self.compressor.compress(payload)
        self.sink.write(packed)
        self.entries.append(_ENTRY.pack(len(packed), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
        self.places.append(_PLACE.pack(self.documents, self.ids))
        self.documents += len(self._held)
        self.ids += self._size
        self._held, self._size = [], 0

    def close(self) -> None:
        self._flush()
        directory = b"".join(self.places) + _PLACE.pack(self.documents, self.ids)
        self.sink.write(struct.pack("<II", _DIRECTORY_FRAME, len(directory)) + directory)
        table = b"".join(self.entries)
        table += _FOOTER.pack(len(self.entries), _HAS_CHECKSUMS, _SEEK_MAGIC)
        self.sink.write(struct.pack("<II", _SEEK_FRAME, len(table)) + table)


@dataclass(frozen=True)
class Document:
    ordinal: int
    doc_id: int | None
    start: int
    ids: np.ndarray


class FrameReader:
    """Reads documents of one file; only the frames that are asked for are fetched."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEK_MAGIC or flags != _HAS_CHECKSUMS:
            raise ValueError("no seek table")
        table = size - _FOOTER.size - frames * _ENTRY.size
        entries = self._at(table, frames * _ENTRY.size)
        self.entries = list(_ENTRY.iter_unpack(entries))
        directory = (frames + 1) * _PLACE.size
        self.places = list(_PLACE.iter_unpack(self._at(table - 8 - directory, directory)))
        self.offsets = np.concatenate(([0], np.cumsum([e[0] for e in self.entries], dtype=np.int64))).tolist()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        found = self.source.read(size)
        if len(found) != size:
            raise ValueError("the file is cut short")
        return found

    @property
    def documents(self) -> int:
        return self.places[-1][0]

    def frame(self, number: int) -> list[Document]:
        packed, size, checksum = self.entries[number]
        payload = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[number], packed))
        if len(payload) != size or xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} does not match its checksum")
        (n,) = struct.unpack_from("<I", payload)
        heads = np.frombuffer(payload, np.dtype([("doc", "<i8"), ("n", "<u8")]), n, 4)
        ids = np.frombuffer(payload, "<u4", offset=4 + 16 * n)
        cuts = np.concatenate(([0], np.cumsum(heads["n"].astype(np.int64)))).tolist()
        first, start = self.places[number]
        return [
            Document(first + i, None if d == _NO_ID else d, start + cuts[i], ids[cuts[i] : cuts[i + 1]])
            for i, d in enumerate(heads["doc"].tolist())
        ]

    def document(self, ordinal: int) -> Document:
        """One document by its place in the file, from the one frame that holds it."""
        if not 0 <= ordinal < self.documents:
            raise IndexError(ordinal)
        number = int(np.searchsorted([p[0] for p in self.places], ordinal, side="right")) - 1
        return self.frame(number)[ordinal - self.places[number][0]]

    def __iter__(self) -> Iterator[Document]:
        for number in range(len(self.entries)):
            yield from self.frame(number)


def _open(path: str, mode: str):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place) if mode == "r" else system.open_output_stream(place, compression=None)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    *,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Encode all documents into files under ``folder``, in ascending order of doc_id.

    Result, one row per file: ``file`` (its place in the order), ``path``, ``n_docs``,
    ``n_ids``. Each document's ids are followed by ``end_id``; a null text has no other. Null
    ids stand first and rows that share an id stand next to each other. A file is written under a name of
    its own by each attempt of its task, and only the names of attempts that ended well are in
    the result, so a lost executor leaves at most an orphan. The folder must be one that all
    executors reach.
    """
    classes = class_table()
    rows = narrow(docs, text=text, doc_id=doc_id).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, end = _encoder(tokenizer_path, classes), TaskContext.get(), struct.pack("<I", end_id)
        path = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.zst"
        sink = writer = None
        gc.disable()  # many strings and no cycles; the collector would walk all of them again and again
        try:
            for batch in slices(batches, "text"):
                if writer is None:
                    sink = _open(path, "w")
                    writer = FrameWriter(sink, frame_ids)
                for number, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                    writer.add(number, ids + end)
        finally:
            gc.enable()
        if writer is not None:
            writer.close()
            sink.close()
            columns = [[task.partitionId()], [path], [writer.documents], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "path", "n_docs", "n_ids"])

    return materialise(ordered.mapInArrow(run, "file bigint, path string, n_docs bigint, n_ids bigint"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it, in this file and those before.
    """
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    count = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with _open(path, "r") as source:
                    reader = FrameReader(source)
                    for number in range(len(reader.entries)):
                        found = reader.frame(number)
                        columns = [
                            pa.array([d.doc_id for d in found], pa.int64()),
                            pa.array([base + d.start for d in found], pa.int64()),
                            pa.array([len(d.ids) for d in found], pa.int64()),
                            pa.array([zlib.crc32(d.ids.tobytes()) for d in found], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(max(1, count)).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/token-files-{uuid.uuid4().hex[:12]}"
