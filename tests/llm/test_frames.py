import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemark.llm.frames import ChunkEncoder, FrameReader, FrameWriter, read_token_files, write_token_files
from tidemark.llm.pretokenize import class_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["'", "s", "t", "re", "ll", "e", " ", " ", " ", "  ", "\n", "\t", " ", "a", "é", "9", "!", "#", "😀", "\0", "中", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    random.seed(3)
    encoder = ChunkEncoder(PATH, class_table())
    for _ in range(300):
        texts = ["".join(random.choices(ALPHABET, k=random.randrange(14))) for _ in range(8)]
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [ids_of(library, t) for t in texts]


def test_strings_of_added_tokens_get_their_ids(documents, tmp_path):
    plain = Tokenizer.from_file(PATH)
    random.seed(4)
    encoder = ChunkEncoder(PATH, class_table(), added_tokens=True)
    for _ in range(300):
        texts = ["".join(random.choices(ALPHABET, k=random.randrange(14))) for _ in range(8)]
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [ids_of(plain, t) for t in texts]
    texts = ["a <|endoftext|> b", "a b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext"]
    files = write_token_files(documents(list(enumerate(texts))), PATH, str(tmp_path / "tokens"))
    found = {r["doc_id"]: r for r in read_token_files(files).collect()}
    for i, t in enumerate(texts):
        ids = [*ids_of(plain, t), 2]
        assert (found[i]["n_tokens"], found[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert 50256 in ids_of(plain, texts[0])


def test_plain_words_are_merged_once():
    plain = Tokenizer.from_file(PATH)
    encoder = ChunkEncoder(PATH, class_table(), added_tokens=True)
    merged, tokenize = [], encoder.tokenize
    encoder.tokenize = lambda piece: merged.append(piece) or tokenize(piece)
    texts = ["Zorble quaffle, quaffle. quaffle", "quaffle Zorble. zorblé, a,. , .", "Zorble, " + "Zorble" * 20 + " it's, zorblé"]
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [ids_of(plain, t) for t in texts]
    short = [m for m in merged if len(m) < 40]
    assert len(short) == len(set(short)) and {"Ġquaffle", "ĠZorble"} <= set(short)


def written(documents, frame_ids):
    sink = pa.BufferOutputStream()
    writer = FrameWriter(sink, frame_ids)
    for i, ids in documents:
        writer.add(i, np.array(ids, "<u4").tobytes())
    writer.close()
    return sink.getvalue().to_pybytes()


def test_reader_fetches_single_documents_and_any_zstandard_reader_the_frames():
    documents = [(None if i == 0 else i * 3, list(range(i, i + i % 7))) for i in range(100)]
    raw = written(documents, 20)
    reader = FrameReader(pa.BufferReader(raw))
    assert [(d.doc_id, d.ids.tolist()) for d in reader] == documents
    assert len(reader.entries) > 10 and reader.documents == 100
    for i in (0, 1, 57, 99):
        got = reader.document(i)
        assert (got.ordinal, got.doc_id, got.ids.tolist()) == (i, *documents[i])
        assert got.start == sum(len(d[1]) for d in documents[:i])
    with pytest.raises(IndexError):
        reader.document(100)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(whole) == sum(e[1] for e in reader.entries)


def test_damage_is_noticed():
    raw = bytearray(written([(1, list(range(500)))], 10))
    raw[30] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(FrameReader(pa.BufferReader(bytes(raw))))
    with pytest.raises(ValueError):
        FrameReader(pa.BufferReader(bytes(raw[:-1])))


def test_files_hold_all_documents_in_order(spark, documents, library, tmp_path):
    random.seed(8)
    rows = [(random.randrange(-1000, 1000) * 7 + i % 7, " ".join(random.choices(["the", "wörd", "it's", "\n", ""], k=random.randrange(40)))) for i in range(300)]
    rows += [(None, "no id"), (None, None), (5000, None), (5001, ""), (5002, "long " * 20000), (5003, "twice"), (5003, "twice")]
    files = write_token_files(documents(rows), PATH, str(tmp_path / "tokens"), frame_ids=300)
    found = read_token_files(files).collect()
    assert len(found) == len(rows)
    start = 0
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*ids_of(library, t or ""), 2])
    previous = None
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start and (previous is None or r["doc_id"] >= previous)
        match = [x for x in ids[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"]]
        ids[r["doc_id"]].remove(match[0])
        assert len(match[0]) == r["n_tokens"]
        start, previous = start + r["n_tokens"], r["doc_id"]
    assert not any(ids.values())


def test_empty_table(documents, tmp_path):
    assert read_token_files(write_token_files(documents([]), PATH, str(tmp_path / "none"))).collect() == []
