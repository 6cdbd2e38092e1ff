import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import by
from tidemark.llm import perplexity
from tidemark.llm.perplexity import (
    ORDER,
    QualityRules,
    bands,
    keys_of,
    ngram_counts,
    quality_rules,
    symbol_table,
    text_counts,
    train_model,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text, window=3):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    covered = {i + j for i in range(len(words) - window + 1) if windows[tuple(words[i : i + window])] > 1 for j in range(window)}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_counts_equal_the_plain_ones():
    random.seed(1)
    texts = ["", " ", "a b c", "a a a a", "a b c a b c a b", "x\nx\n \ny\nx ", "é # $$ <a>|", "a\x0bb\x85c d", "w " * 3000]
    texts += [" ".join(random.choices("abc", k=random.randrange(30))) + random.choice(["", "\n"]) for _ in range(200)]
    for text in texts:
        assert text_counts(text, 3) == plain_counts(text)


def test_keys_stay_within_each_text():
    symbols = symbol_table()
    keys, ends = keys_of(["ab", "", "cde", "x"])
    assert ends.tolist() == [2, 2, 5, 6]
    flat = [[int(k) >> 6 * i & 63 for i in range(ORDER - 1, -1, -1)] for k in keys]
    s = {c: int(symbols[ord(c)]) for c in "\nabcdex"}
    grams = ["\n\n\na", "\n\nab", "\n\n\nc", "\n\ncd", "\ncde", "\n\n\nx"]
    assert flat == [[s[c] for c in g] for g in grams]
    assert int(symbols.max()) < 64


def kneser_ney(texts):
    """The same model by dictionaries, from the definition."""
    counts = [Counter() for _ in range(ORDER + 1)]
    symbols = symbol_table()
    for t in texts:
        padded = [0] * (ORDER - 1) + [int(symbols[ord(c)]) for c in t]
        for i in range(len(t)):
            counts[ORDER][tuple(padded[i : i + ORDER])] += 1
    for order in range(ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    below = defaultdict(lambda: 1 / 64)
    for order in range(1, ORDER + 1):
        kinds = Counter(counts[order].values())
        n = [0, *(kinds[i] for i in range(1, 5))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else 0.5 for i in (1, 2, 3)}
        total, left = Counter(), defaultdict(float)
        for g, c in counts[order].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        now = {}
        for g, c in counts[order].items():
            lower = below[g[1:]] if order > 1 else 1 / 64
            now[g] = (c - d[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * lower
        below = now
    return below


@pytest.fixture(scope="module")
def texts():
    random.seed(2)
    syllables = ["an", "the", "ing", "or", "é", "st", "re", ". ", "\n", " ", " ", " "]
    return ["".join(random.choices(syllables, k=random.randrange(1, 120))) for _ in range(120)]


def test_model_equals_kneser_ney_by_definition(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sum(r["n"] for r in ngram_counts(df).collect()) == sum(map(len, texts))
    model, expected = train_model(df), kneser_ney(texts)
    grams = list(expected)
    keys = np.array([sum(s << 6 * (ORDER - 1 - i) for i, s in enumerate(g)) for g in grams], np.uint32)
    found = model.log_probabilities(keys)
    assert np.allclose(found, np.log([expected[g] for g in grams]), atol=1e-5)
    # Backing off gives a distribution over all symbols after a context, seen or not.
    for context in (grams[0][:-1], grams[5][:-1], (63, 62, 61), (0, 0, 63)):
        base = sum(s << 6 * (ORDER - 1 - i) for i, s in enumerate(context))
        total = np.exp(model.log_probabilities(np.arange(base, base + 64, dtype=np.uint32))).sum()
        assert abs(total - 1) < 1e-3


def test_code_points_of_one_symbol_have_shares_of_their_own(spark, documents):
    symbols = symbol_table()
    common, rare, never = "\u4e00", "\u4e05", "\u4e0a"  # five apart: one symbol
    assert len({int(symbols[ord(c)]) for c in (common, rare, never)}) == 1
    texts = [common * 30 + rare, "abc 1 22 Ab", None]
    model = train_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    shares = np.exp(model.log_shares().astype(float))
    assert np.allclose(np.bincount(symbols, shares)[np.unique(symbols)], 1, atol=1e-3)
    assert math.isclose(shares[ord(common)], 30 / 33, rel_tol=1e-5) and math.isclose(shares[ord(rare)], 1 / 33, rel_tol=1e-5)
    assert shares[ord("a")] == shares[ord("x")] == 1  # letters have symbols of their own, seen or not
    assert 0 < shares[ord(never)] < shares[ord(rare)]
    # As n-grams of symbols the two documents are the same; only their code points differ.
    rows = [(i, common * 5 + " ", "zh") for i in range(50)] + [(50, rare * 5 + " ", "zh")]
    got = {r["doc_id"]: r["perplexity"] for r in quality_rules(documents(rows)).collect()}
    assert got[50] > 5 * got[0]


def prose(n, words):
    return " ".join(random.choices(words, k=n))


def test_verdicts(documents):
    random.seed(3)
    words = ["".join(random.choices(["an", "the", "ing", "or", "st", "re", "on"], k=random.randrange(1, 4))) for _ in range(900)]
    rows = [(i, prose(random.randrange(60, 200), words), "en") for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, prose(49, words), "en"), (1003, "again and again " * 40, "en")]
    rows += [(1004, " ".join("".join(random.choices("QZX#@~^{}=", k=6)) for _ in range(100)), "en"), (1005, "a b " * 60000, "de")]
    rows += [(1006, prose(80, words), None), (1007, prose(80, words), "rare"), (None, prose(80, words), "en"), (5, rows[5][1], "en")]
    found = quality_rules(documents(rows), carry=("kept", "score")).collect()
    assert len(found) == len(rows) and {tuple(r["carried"]) for r in found} == {("x", "x")}
    got = {r["doc_id"]: r for r in found}
    for i, text, _ in rows:
        r = got[i]
        n, chars, symbols, lines, repeats = plain_counts(text or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    assert all(r["kept"] for r in found if r["doc_id"] is None or r["doc_id"] < 300)
    assert [got[i]["kept"] for i in range(1000, 1008)] == [False] * 6 + [True, True]
    assert not got[1004]["base_failed"] and got[1004]["perplexity"] > got[1004]["perplexity_high"]
    assert got[1000]["perplexity"] is None


def test_small_and_empty_tables(documents):
    assert quality_rules(documents([])).collect() == []
    assert by(quality_rules(documents([(1, None), (2, "one")])), "doc_id", "n_words", "kept") == [(1, 0, False), (2, 1, False)]
    assert math.isclose(QualityRules().band, 6.0)


def test_a_band_of_its_own_does_not_depend_on_other_languages(spark):
    rules = QualityRules()
    own = spark.range(300).selectExpr("'small' as lang", "1.0 + id / 1000 as log_perplexity", "false as base_failed")
    rest = spark.range(400_000).selectExpr("'large' as lang", "3.0 + id % 100 / 1000 as log_perplexity", "false as base_failed")
    few = spark.range(199).selectExpr("'few' as lang", "2.0D as log_perplexity", "false as base_failed")
    alone = {r["lang"]: r for r in bands(own, rules, "lang").collect()}
    among = {r["lang"]: r for r in bands(own.union(rest).union(few), rules, "lang").collect()}
    assert set(among) == {"small", "large", None} and among["small"] == alone["small"]


def test_bands_joined_by_a_shuffle_give_the_same_verdicts(documents, monkeypatch):
    rows = [(i, f"some words in row {i} " * 15, [None, "a", "b"][i % 3]) for i in range(60)]
    rules = QualityRules(min_texts=10, max_repeat_percent=100)
    columns = ("doc_id", "kept", "perplexity_low", "perplexity_high")
    sent = by(quality_rules(documents(rows), rules), *columns)
    monkeypatch.setattr(perplexity, "MOST_LANGUAGES", 0)
    assert by(quality_rules(documents(rows), rules), *columns) == sent and len(sent) == 60


def kneser_ney_of_points(texts, model):
    """The model of code points by dictionaries, from the definition; below it the model of classes."""
    symbols, shares = symbol_table(), model.log_shares().astype(float)
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        padded = "\n" * (ORDER - 1) + t
        counts[ORDER].update(padded[i : i + ORDER] for i in range(len(t)))
    for order in range(ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    cuts, totals, left = [None], [None], [None]
    for order in range(1, ORDER + 1):
        kinds = Counter(counts[order].values())
        n = [0, *(kinds[i] for i in range(1, 5))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else 0.5 for i in (1, 2, 3)}
        total, mass = Counter(), defaultdict(float)
        for g, c in counts[order].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        cuts.append(d)
        totals.append(total)
        left.append(mass)

    def p(gram, whole):
        if not gram:
            key = sum(int(symbols[ord(c)]) << 6 * (ORDER - 1 - i) for i, c in enumerate(whole))
            return math.exp(model.log_probabilities(np.array([key], np.uint32))[0] + shares[ord(whole[-1])])
        k, before, c = len(gram), gram[:-1], counts[len(gram)][gram]
        own = (c - cuts[k][min(c, 3)]) / totals[k][before] if c else 0.0
        return own + left[k][before] / totals[k][before] * p(gram[1:], whole)

    return {g: p(g, g) for g in counts[ORDER]}


def point_logs(model):
    return {
        "".join(chr(r["context"] >> 21 * i & 0x1FFFFF) for i in (2, 1, 0)) + chr(r["point"]): r["log"] for r in model.collect()
    }


def test_every_code_point_counts_in_contexts(spark, texts):
    texts = [*texts, "Ab ABBA 一丅\U0001f600\U0010ffff", "丅一 zE", "", "A"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    expected = kneser_ney_of_points(texts, train_model(df))
    found = point_logs(perplexity.point_model(df))
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[g], math.log(expected[g]), abs_tol=1e-5) for g in found)


def test_texts_alike_by_class_differ_by_their_code_points(documents):
    # Capitals, digits and code points five apart are of one class each; what follows them is not the same.
    rows = [(i, "Ax 1y 一z Bq 2r 丅s " * 5, "en") for i in range(60)]
    rows += [(100, "Bx 2y 丅z Aq 1r 一s ", "en")]
    symbols = symbol_table()
    as_classes = {tuple(int(symbols[ord(c)]) for c in t[:18]) for _, t, _ in (rows[0], rows[-1])}
    assert len(as_classes) == 1
    got = {r["doc_id"]: r["perplexity"] for r in quality_rules(documents(rows)).collect()}
    assert got[100] > 1.5 * got[0]


def test_n_grams_of_many_code_points_and_in_pieces(spark, documents, texts, monkeypatch):
    def grams(texts):
        contexts, points, which, ends = perplexity.grams_of(texts)
        return list(zip(contexts[which].tolist(), points[which].tolist())), ends.tolist()

    wide = ["".join(map(chr, random.Random(4).choices(range(0x3400, 0x3500), k=900))), "", "\U0010ffff" * 5, "ab"]
    packed = grams(wide)
    monkeypatch.setattr(perplexity, "_PACKED", 2)
    assert grams(wide) == packed and packed[1] == [900, 900, 905, 907]
    monkeypatch.undo()
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    whole = by(quality_rules(documents(rows)), "doc_id", "perplexity")
    for name, size in (("_HELD", 4), ("_LOOKED_UP_BYTES", 100), ("_PIECE", 7), ("_SCORED_BYTES", 64)):
        monkeypatch.setattr(perplexity, name, size)
    for (i, a), (j, b) in zip(whole, by(quality_rules(documents(rows)), "doc_id", "perplexity")):
        assert i == j and math.isclose(a, b, rel_tol=1e-9)
