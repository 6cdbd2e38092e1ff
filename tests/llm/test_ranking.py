import random
import zlib

import pytest

from tests.llm.conftest import by
from tidemark.llm.ranking import FEATURES, features_of, rank_quality


def good():
    return " ".join(random.choices(["the", "house", "stands", "near", "a", "river", "and", "trees."], k=random.randrange(20, 200)))


def bad():
    kind = random.randrange(3)
    if kind == 0:
        return " ".join(w + random.choice(["###", "$$$"]) for w in good().split())
    return " ".join(w.upper() + "!!" for w in good().split()) if kind == 1 else " | ".join(good().split()[:30])


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    return [(i, good() if i % 4 else bad()) for i in range(800)]


def test_features_are_finite_for_any_text():
    for text in ("", " ", "a", "a a", "\n\n", "x" * 100000, "é\x00", "| | |"):
        found = features_of(text.encode())
        assert len(found) == len(FEATURES) and all(abs(x) < 100 for x in found)


def test_held_out_labels_are_neither_read_nor_missed(spark, documents, rows):
    labels = [(i, int(i % 4 > 0)) for i, _ in rows if i % 2 == 0 or i % 3 == 0]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    more = [(5000, None), (5001, ""), (None, "no id but words"), (5002, "word " * 30000), (5003, good()), (5003, good())]
    docs = documents(rows + more)
    schema = "doc_id bigint, quality int"
    found = rank_quality(docs, spark.createDataFrame(labels, schema).selectExpr("*", "'x' as label", "1 as score"))
    got = found.collect()
    assert len(got) == len(rows) + len(more)
    assert all(r["held_out"] == (r["doc_id"] in held) for r in got if r["doc_id"] is not None and r["doc_id"] < 800)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    tested = [r for r in got if r["doc_id"] in held]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in tested) > 0.95 * len(tested)
    # Held-out labels turned round, null labels, contradictions and strangers change nothing.
    noisy = [(i, 1 - q if i in held else q) for i, q in labels] + [(3, None), (None, 1), (99999, 0), (5003, 0), (5003, 1)]
    again = rank_quality(docs, spark.createDataFrame(noisy + labels[:50], schema))
    kept = [(i, q) for i, q in labels[:50] if i in held]
    assert kept and by(again, "doc_id", "predicted") == by(found, "doc_id", "predicted")


def test_without_both_classes_there_is_nothing_to_learn(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    for labels in ([], [(1, 1)], [(77, 0)]):
        found = rank_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert by(found, "doc_id", "score", "predicted") == [(1, 0.5, 0), (2, 0.5, 0)]
    assert rank_quality(documents([]), spark.createDataFrame([], "doc_id bigint, quality int")).collect() == []
