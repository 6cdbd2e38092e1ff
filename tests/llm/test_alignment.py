import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.alignment import Aligner, Found, align_documents
from tidemark.llm.pretokenize import class_table

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALPHABET = ["'", "s", "the", "ing", "Über", " ", " ", " ", "  ", "\n", "\t", " ", "é", "9", "!", "😀", "\0", "中文", "<s>", "<|endoftext|>", "#", "    ", "\r\n", "ﬁ"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [i for i in range(256) if i not in shown]
    raw_of = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        found_a = a.encode(" " + text, add_special_tokens=False).ids
        found_b = b.encode(text)
        return [(i, bytes(raw_of[c] for c in a.id_to_token(i))) for i in found_a], [(i, piece(i)) for i in found_b]

    return tokens


def plain_groups(text, tokens):
    """Groups of ids, cut at byte offsets where both sides end; none where bytes are lost."""
    if not text:
        return []
    sides = tokens(text)
    if any(b"".join(t[1] for t in side) != (" " + text).encode() for side in sides):
        return []
    ends = []
    for side in sides:
        at, found = 0, []
        for _, raw in side:
            at += len(raw)
            found.append(at)
        ends.append(found)
    out, start = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        stop = [e.index(cut) + 1 for e in ends]
        out.append(tuple([t[0] for t in side[i:j]] for side, i, j in zip(sides, start, stop)))
        start = stop
    return out


def plain(rows, tokens):
    groups = [plain_groups(t or "", tokens) for _, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    counts = Counter(pair for found in links for pair in found)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for (i, _), g, found in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                i,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                found.total(),
                sum(n for (a, b), n in found.items() if counts[a, b] == best[a]),
                sum(n * counts[p] for p, n in found.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=repr)


def rows_of(rng):
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randrange(25)))) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choices(["the", "Wörter", "it's", "x1", "alignment,", "中"], k=rng.randrange(60)))) for i in range(50)]
    rows += [(None, "no id"), (None, None), (300, None), (301, ""), (302, " "), (303, "a "), (304, "▁"), (305, "a▁b the")]
    return rows + [(306, "twice the same"), (306, "twice the same"), (307, "a" * 5000), (308, "😀" * 700), (309, " " * 333 + "x")]


@pytest.mark.parametrize("most_hot", [1 << 18, 40, 0])
def test_alignment_equals_brute_force(documents, libraries, most_hot):
    rows = rows_of(random.Random(1))
    found = align_documents(documents(rows), BYTES, PIECES, most_hot=most_hot)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows, libraries)


def aligned(texts):
    aligner, found = Aligner(BYTES, PIECES, class_table()), [Found() for _ in texts]
    units = [(u, d) for t, d in zip(texts, found) for u in aligner.units(t)]
    aligner.align([u for u, _ in units], [d for _, d in units])
    return units, [(d.n_a, d.n_b, d.n_groups, d.digest.hexdigest()) for d in found]


def test_long_texts_are_aligned_in_parts_alike(monkeypatch, libraries):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "wörd", "it's", "\n", "", "中文", "a1"], k=4000)) for _ in range(3)] + ["nospace" * 3000]
    whole_units, whole = aligned(texts)
    assert len(whole_units) == len(texts)
    monkeypatch.setattr(alignment, "_UNIT_CHARS", 500)
    units, parts = aligned(texts)
    assert len(units) > 30 and parts == whole
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(texts[0], libraries))
    assert whole[0][3] == hashlib.sha256(text.encode()).hexdigest()


def test_wide_groups_count_equal_ids_once(monkeypatch, documents, libraries):
    rows = [(i, "x" * n + "é" * n + "😀" * n) for i, n in enumerate([1, 7, 90])]
    monkeypatch.setattr(alignment, "_WIDE_GROUP", 1)
    aligner, found = Aligner(BYTES, PIECES, class_table()), Found()
    aligner.align([" " + rows[2][1]], [found])
    expected = Counter(a * aligner.width + b for ga, gb in plain_groups(rows[2][1], libraries) for a in ga for b in gb)
    code, times = alignment._together(found)
    assert dict(zip(code.tolist(), times.tolist())) == expected


def test_empty_table(documents):
    assert align_documents(documents([]), BYTES, PIECES).collect() == []
