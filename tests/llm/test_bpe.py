import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import by
from tidemark.llm import bpe
from tidemark.llm.bpe import Codec, encode_documents, merge, merge_long
from tidemark.llm.pretokenize import class_table, load_table, pieces, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "l", "e", "m", "d", " ", "  ", "\n", "\t", " ", "　", "a", "é", "9", "²",
            "!", "#", "😀", "\0", "中", "́", "‍", "S", "\x85", "ͺ"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH), class_table())


def test_pieces_join_to_the_text_and_ids_equal_the_library(codec, library):
    random.seed(5)
    texts = ["".join(random.choices(ALPHABET, k=random.randrange(16))) for _ in range(4000)]
    ids, upto = codec.encode(texts)
    cuts = [0, *upto.tolist()]
    assert [ids[i:j] for i, j in zip(cuts, cuts[1:])] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, upto) == [t.encode() for t in texts]
    found, _ = pieces(texts, load_table(class_table()))
    assert "".join(found) == "".join(texts)


def test_long_pieces_merge_alike(codec):
    random.seed(6)
    for size in (1, 2, 3, 50, 400):
        piece = "".join(random.choices("abeé", k=size)).encode()
        assert merge(piece, codec.ranks) == merge_long(piece, codec.ranks)


def test_short_pieces_merge_side_by_side_and_not_one_by_one(library, monkeypatch):
    random.seed(7)
    words = ["".join(random.choices("abcdeéßthin", k=random.randrange(2, 30))) for _ in range(6000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    monkeypatch.setattr(bpe, "merge", lambda *_: pytest.fail("a short piece was merged alone"))
    for pieces_held in (bpe.CACHE_PIECES, 500):
        monkeypatch.setattr(bpe, "CACHE_PIECES", pieces_held)
        codec, found = Codec(read_ranks(PATH), class_table()), []
        for i in range(0, len(texts), 50):
            ids, upto = codec.encode(texts[i : i + 50])
            cuts = [0, *upto.tolist()]
            found += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        assert found == [library.encode_ordinary(t) for t in texts]


def test_ranks_without_all_bytes(library):
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b" ": 4, b" a": 5}
    ids, upto = Codec(ranks, class_table()).encode(["ababab ab", "", "b"])
    assert (ids, upto.tolist()) == ([3, 2, 4, 2, 1], [4, 4, 5])


def test_documents_of_all_kinds(documents, library):
    rows = [(1, "It's a test.  \n\nYes'll"), (2, None), (3, ""), (3, "again"), (None, " "), (9, "wörd " * 3000), (10, "a" * 5000)]
    found = by(encode_documents(documents(rows), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    expected = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        expected.append((i, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert found == sorted(expected, key=repr)


def test_empty_table(documents):
    assert encode_documents(documents([]), PATH).collect() == []
