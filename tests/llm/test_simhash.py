import random
from itertools import combinations

import numpy as np
import xxhash

from tests.llm.conftest import by
from tidemark.llm.simhash import clean_sets, fingerprint, linked_in_list, simhash_groups


def plain(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints_equal_the_plain_count():
    for text in ("", "one", "One two three", "a b c d", "a b c d e f g " * 40, "é ü x a\x0bb\x0cc", "\t\n"):
        assert fingerprint(text.encode(), 4) & (1 << 64) - 1 == plain(text)


def test_every_guaranteed_set_of_equal_bytes_holds_an_indexed_one():
    for bits in (2, 3, 4, 5):
        sets = [set(s) for s in clean_sets(bits)]
        assert all(any(s <= set(agreeing) for s in sets) for agreeing in combinations(range(8), 8 - bits))
    assert len(clean_sets(4)) == 20


def test_links_of_a_list():
    fps = np.array([0, 0b1111, 0b11111, 1 << 63, (1 << 64) - 1], np.uint64)
    forest = linked_in_list(fps, 4)
    assert [forest.find(i) for i in range(5)] == [0, 0, 0, 0, 4]


def brute(rows):
    fps = [plain(t) for _, t in rows]
    component = [i for i in range(len(rows))]

    def find(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            component[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_groups_equal_brute_force_also_when_lists_are_split(documents):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = random.choices(vocabulary, k=random.randrange(30, 120))
        for _ in range(random.randrange(1, 7)):
            copy = list(words)
            for _ in range(random.randrange(3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "few words"), (n + 4, "x " * 20000), (None, rows[0][1])]
    random.shuffle(rows)
    for limit in (4096, 3):
        found = simhash_groups(documents(rows), block_rows=limit)
        assert by(found, "doc_id", "fingerprint", "component_id") == brute(rows)


def test_repeated_rows_share_a_group_and_empty_tables_give_none(documents):
    found = simhash_groups(documents([(2, "a b c d e"), (2, "a b c d e"), (1, None), (5, None)]))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in found.orderBy("doc_id", "kept").collect()] == [
        (1, 1, True), (2, 2, True), (2, 2, True), (5, 1, False),
    ]
    assert simhash_groups(documents([])).collect() == []
