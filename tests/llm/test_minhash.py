import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.minhash import BINS, BITS, Fingerprints, edited, fingerprint_documents

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def shingles(text, k=5):
    words = text.encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def words(n, rng, of=5000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.mark.parametrize("bins,bits", [(BINS, BITS), (256, 8), (128, 1)])
def test_likeness_is_unbiased_for_texts_of_all_lengths(bins, bits):
    rng, maker = random.Random(1), Fingerprints(bins=bins, bits=bits)
    for n in (12, 60, 400, 3000):
        errors = []
        for _ in range(60):
            a = words(n, rng)
            cut = rng.randrange(n)
            b = " ".join(a.split()[:cut]) + " " + words(n - cut, rng)
            low = maker.of([a.encode(), b.encode()])
            errors.append(maker.likeness(low[:1], low[1:])[0] - jaccard(a, b))
        # Clipping at zero adds a little; sparse texts vary more, since bins share minima.
        spread = 0.5 / np.sqrt(min(bins * bits / 4, n))
        assert abs(np.mean(errors)) < 0.02 + spread / 4, (n, np.mean(errors))
        assert np.std(errors) < 0.03 + spread, (n, np.std(errors))


def test_bins_hold_minima_of_hashes_made_once():
    maker, text = Fingerprints(), words(40, random.Random(2)).encode()
    hashes, owner = maker._shingles([text, text])
    assert len(hashes) == 2 * 36 and owner.tolist().count(0) == 36 and len(set(hashes.tolist())) == 36
    assert (maker.of([text]) == maker.of([b"x", text])[1]).all()


def test_texts_without_shingles_of_full_length():
    maker = Fingerprints()
    low = maker.of([b"", b" \n", b"one", b"one two", b" one  two ", b"two one", b"\0"])
    near = lambda i, j: maker.likeness(low[i : i + 1], low[j : j + 1])[0]
    assert near(0, 1) == near(3, 4) == 1.0
    assert max(near(0, 2), near(2, 3), near(3, 5), near(0, 6)) < 0.2


def test_packed_bits_are_those_of_the_bins():
    maker = Fingerprints(bins=16, bits=4)
    low = maker.of([b"a b c d e f g"])
    assert maker.packed(low)[0].hex() == "".join(f"{v:x}" for v in low[0])


def test_long_texts_are_hashed_in_blocks_alike():
    text = words(400_000, random.Random(3)).encode()
    maker = Fingerprints()
    assert len(maker._word_hashes(text)) > 1
    whole = Fingerprints()
    whole._word_hashes = lambda raw: [np.concatenate(maker._word_hashes(raw))]
    assert (maker.of([text]) == whole.of([text])).all()


def test_edited_text():
    assert edited("abcdefgh", "XYZ") == "abcdefXY" and edited("abcdefgh", "X") == "abcdefX"
    assert edited("abc", "XYZ") == "abc" and edited("", "XYZ") == "" and edited("äöüé", "中") == "äöü中"


def test_documents_in_order_of_id(spark, documents):
    rng = random.Random(4)
    rows = [(i * 3, words(rng.choice([0, 1, 4, 5, 50, 300]), rng), "en", "s") for i in range(-40, 160)]
    rows += [(1000, rows[0][1], "en", "s"), (1001, rows[0][1], "en", "s"), (1002, None, None, None), (1003, "", None, None)]
    rows += [(1004, "😀 é " * 50_000, None, None), (1005, "long " * 100_000, None, None)]
    rng.shuffle(rows)
    df = documents(rows).repartition(7)
    for parts in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = fingerprint_documents(df)
            assert found.columns == COLUMNS
            got = {r["doc_id"]: r for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert len(got) == len(rows)
        maker = Fingerprints()
        hexed = lambda t: maker.packed(maker.of([t.encode()]))[0].hex()
        ordered = sorted((i, t or "") for i, t, *_ in rows)
        for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
            r, changed = got[i], edited(text, following)
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(text), hexed(changed))
            low = maker.of([text.encode(), changed.encode(), following.encode()])
            assert r["near_edited"] == maker.likeness(low[:1], low[1:2])[0]
            assert r["near_next"] == maker.likeness(low[:1], low[2:])[0]
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"] and got[1000]["near_next"] == 1.0


def test_nulls_and_repeats_in_doc_id(documents):
    rows = [(None, "b"), (None, "a"), (1, "same " * 9), (1, "same " * 9), (1, "other"), (2, None)]
    found = fingerprint_documents(documents(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "1", "2", "None", "None"]
    assert all(0 <= r["near_next"] <= 1 for r in found)


def test_one_row_and_none(documents):
    assert fingerprint_documents(documents([])).collect() == []
    (r,) = fingerprint_documents(documents([(1, "abcdefgh")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
