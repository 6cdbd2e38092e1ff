import random
from itertools import permutations

import numpy as np
import pytest

from tidemark.llm.audit import LETTERS, audit_documents, positional_counts

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4097])
def test_carry_save_counts_equal_plain_ones(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert positional_counts(words).tolist() == [int(((words >> np.uint32(s)) & 1).sum()) for s in range(32)]


def fails_of(rows):
    firsts = {}
    for i, text, _, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    out = []
    for i, text, _, source in rows:
        text = text or ""
        words = text.encode().split()
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and firsts[text] < i:
            fails.add("E")
        out.append((source or "", i, fails))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    documents = fails_of(rows)
    out = []
    for part in {p for p, _, _ in documents}:
        own = [(i, f) for p, i, f in documents if p == part]
        found = []
        for order in permutations(LETTERS):
            alive = list(own)
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in alive if letter in f]
                alive = [(i, f) for i, f in alive if letter not in f]
                redundant = sum(letter in f for _, f in own) - len(removed)
                alone = sum(f == {letter} for _, f in own)
                lost = [sum(i in ids for i, _ in removed) for ids in (good, toxic)]
                found.append(("".join(order), step, letter, len(alive), len(removed), redundant, alone, *lost))
        for order, step, letter, kept, removed, *more in found:
            shapley = sum(r[4] for r in found if r[2] == letter)
            out.append((part, order, step, kept, removed, *more, shapley))
    return sorted(out)


def test_audit_equals_applying_the_filters_in_every_order(spark, documents):
    random.seed(5)

    def text():
        words = random.choices(["a", "b", "Word", "été", "#", "x&y"] + [f"w{i}" for i in range(300)], k=random.choice([0, 3, 199, 200, 400]))
        return random.choice([" ", "\n", "\t "]).join(words)

    rows = [(i, text(), None, random.choice(["web", "book", "", None])) for i in range(150)]
    copied = [(200 + i, rows[i % 7][1], None, "web") for i in range(60)]
    odd = [
        (None, rows[0][1], None, "web"),
        (None, None, None, None),
        (7, rows[7][1], None, "web"),
        (400, None, None, "book"),
        (401, "", None, "book"),
        (402, " \n\t", None, "nul\0"),
        (403, "long " * 100_000, None, "book"),
        (404, "ABC" * 40_000 + "\0", None, "book"),
        (405, " ".join(["one"] * 500), None, "web"),
    ]
    rows = rows + copied + odd
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 300, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (100_000, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as word", "1 as n", "'x' as label")
    found = audit_documents(documents(rows), told)
    assert found.columns == list(COLUMNS)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, labels)


def test_heavy_and_light_copies_are_told_alike(documents, spark):
    rows = [(i, "same" if i % 3 else f"text {i % 100}", None, "s") for i in range(3000, 0, -1)]
    told = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert sorted(tuple(r) for r in audit_documents(documents(rows), told).collect()) == plain(rows, [])


def test_empty_tables(documents, spark):
    told = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit_documents(documents([]), told).collect() == []
