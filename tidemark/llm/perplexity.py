"""Quality rules: counts over words and lines, and character n-gram perplexity bands.

The language model is a modified Kneser-Ney model of four code points, each told from every
other. Spark counts the n-grams of all texts and derives continuation counts, discounts and
interpolated probabilities with joins. The log probabilities of all n-grams are a table in the
shared folder, which tasks read in pieces beside their texts, so none holds it whole.

What the contexts of a code point leave over is dealt out by a second model of the same kind
over 64 classes of code points (symbols) and by the share of each code point in its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialise
from .texts import SPACES, slices, small_batches

ORDER = 4
# A key of the model of classes holds one six-bit symbol per character, so it has at most 2**24
# entries of the highest order whatever the corpus: the bound that lets every task hold it.
_BITS = 6
_SYMBOLS = 1 << _BITS
# An n-gram of code points is its last one, ``point``, and those before it, ``context``: three make 63 bits.
_POINT_BITS = 21
_POINT_MASK = (1 << _POINT_BITS) - 1
# Text whose n-grams are made at once, some tens of bytes for each character.
_SCORED_BYTES = 1 << 18
# Code points of a slice up to which four of their numbers are put into one key.
_PACKED = 1 << 16
# Distinct n-grams that a counting task holds before it hands them on.
_HELD = 1 << 20
# Text that is scored with one pass over the table of n-grams, and rows of it read at once.
_LOOKED_UP_BYTES = 1 << 23
_PIECE = 1 << 18
_SPACES = {ord(c) for c in SPACES}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]_|"
SYMBOL_CHARS = "#*$%&|<>"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: line end, space, digit, capital, a-z, some marks one by one,
    the rest of ASCII together, and all other code points spread over five symbols by number.
    """
    table = np.empty(0x110000, np.uint32)
    table[:] = 58 + np.arange(0x110000) % 5
    table[:128] = 57
    for c in _SPACES:
        table[c] = 1
    table[ord("\n")] = 0
    table[ord("0") : ord("9") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("a") : ord("z") + 1] = np.arange(4, 30)
    for i, c in enumerate(_PUNCTUATION):
        table[ord(c)] = 30 + i
    return table


def keys_of(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each character, and the end of each text.

    The first characters of a text follow line ends.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = "\n" * (order - 1)
    joined = gap + gap.join(texts)
    symbols = symbol_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    keys = symbols.copy()
    for back in range(1, order):
        keys[back:] |= symbols[:-back] << np.uint32(_BITS * back)
    ends = np.cumsum(lengths + order - 1)
    own = np.ones(len(keys), bool)
    for back in range(1, order):
        own[np.concatenate(([0], ends[:-1])) + order - 1 - back] = False
    return keys[own], np.cumsum(lengths)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of code points (contexts, points), which of them ends at each character,
    and the end of each text. The first characters of a text follow line ends.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = "\n" * (ORDER - 1)
    points = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths + ORDER - 1)
    own = np.ones(len(points), bool)
    for back in range(1, ORDER):
        own[np.concatenate(([0], ends[:-1])) + ORDER - 1 - back] = False
    place = np.nonzero(own)[0]
    seen = np.nonzero(np.bincount(points))[0]
    number = np.zeros(seen[-1] + 1, np.uint64)
    number[seen] = np.arange(len(seen))
    at = number[points]
    if len(seen) <= _PACKED:
        bits = np.uint64(16)
        keys = at.copy()
        for back in range(1, ORDER):
            keys[back:] |= at[:-back] << np.uint64(bits * back)
    else:  # pairs are numbered first, two of which make an n-gram
        pairs = at.copy()
        pairs[1:] |= at[:-1] << np.uint64(32)
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        keys = pairs.copy()
        keys[2:] |= pairs[:-2] << np.uint64(32)
    _, first, which = np.unique(keys[place], return_index=True, return_inverse=True)
    last = place[first]
    contexts = np.zeros(len(last), np.int64)
    for back in range(ORDER - 1, 0, -1):
        contexts = contexts << _POINT_BITS | points[last - back].astype(np.int64)
    return contexts, points[last].astype(np.int64), which, np.cumsum(lengths)


def _merged(contexts: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted contexts, sorted keys (place of the context, point) of distinct n-grams, and which one each is."""
    own, at = np.unique(contexts, return_inverse=True)
    keys, which = np.unique(at << _POINT_BITS | points, return_inverse=True)
    return own, keys, which


def point_grams(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(context, point, n): how often each n-gram of code points occurs in all texts; tasks sum before the shuffle."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> list[np.ndarray]:
            contexts, points, n = map(np.concatenate, zip(*held))
            own, keys, which = _merged(contexts, points)
            return [own[keys >> _POINT_BITS], keys & _POINT_MASK, np.bincount(which, n, len(keys)).astype(np.int64)]

        def handed_on() -> Iterator[pa.RecordBatch]:
            columns = summed() if held else [np.zeros(0, np.int64)] * 3
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["context", "point", "n"])

        for batch in slices(batches, text, _SCORED_BYTES):
            contexts, points, which, _ = grams_of(batch.column(text).to_pylist())
            held.append((contexts, points, np.bincount(which, minlength=len(points))))
            size += len(points)
            if size > 2 * _HELD:
                held = [tuple(summed())]
                size = len(held[0][0])
                if size > _HELD:
                    yield from handed_on()
                    held, size = [], 0
        yield from handed_on()

    found = rows.mapInArrow(run, "context bigint, point bigint, n bigint")
    return found.groupBy("context", "point").agg(F.sum("n").alias("n"))


# Code points are counted under the keys from here on, beside those of n-grams of symbols.
_POINTS = 1 << (_BITS * ORDER)


def _symbol_keys(contexts: np.ndarray, points: np.ndarray) -> np.ndarray:
    symbols = symbol_table()
    keys = symbols[points]
    for back in range(1, ORDER):
        keys = keys | symbols[contexts >> _POINT_BITS * (back - 1) & _POINT_MASK] << np.uint32(_BITS * back)
    return keys


def symbol_and_point_counts(grams: DataFrame) -> DataFrame:
    """(key, n): how often each n-gram of symbols and, from ``_POINTS`` on, each code point occurs,
    from the n-grams of code points; each batch sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts, points, n = (batch.column(c).to_numpy() for c in ("context", "point", "n"))
            keys = np.concatenate((_symbol_keys(contexts, points).astype(np.int64), points + _POINTS))
            found, which = np.unique(keys, return_inverse=True)
            counted = np.zeros(len(found), np.int64)
            np.add.at(counted, which, np.concatenate((n, n)))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counted)], ["key", "n"])

    return grams.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def ngram_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(key, n): how often each n-gram of symbols occurs in all texts."""
    return symbol_and_point_counts(point_grams(docs, text=text)).where(F.col("key") < _POINTS)


def _lower(key: str, order: int) -> Column:
    """The key without its first character."""
    return F.col(key).bitwiseAND(F.lit((1 << (_BITS * (order - 1))) - 1).cast("bigint"))


def _discounted(counts: DataFrame, context: Column) -> DataFrame:
    """The n-grams of one order with ``p`` and ``gamma`` before interpolation: ``p`` the discounted
    share of the context, ``gamma`` the mass that the context leaves to the lower order.
    """
    names = [c for c in counts.columns if c != "n"]
    kinds = counts.agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")

    def discount(i: int) -> Column:
        ratio = F.coalesce(F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.0))
        # Without n-grams seen so often there is nothing to estimate from; half is taken off.
        return F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.0), i - (i + 1) * y * ratio)).otherwise(F.lit(0.5))

    cut = kinds.select(*[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    d = F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end")
    with_cut = counts.crossJoin(F.broadcast(cut)).select(*names, "n", d.alias("d"), context.alias("of"))  # one row
    totals = with_cut.groupBy("of").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    joined = with_cut.join(totals, "of")
    return joined.select(*names, ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("gamma"))


@dataclass(frozen=True)
class CharacterModel:
    """Sorted n-gram keys with log probabilities, and sorted contexts with log back-off mass,
    by order; order 1 holds all symbols. ``points`` are the code points seen, ``times`` their counts."""

    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    masses: tuple[np.ndarray, ...]
    points: np.ndarray
    times: np.ndarray

    def log_shares(self) -> np.ndarray:
        """log p of each code point given its symbol, which is 0 where the symbol is its own.

        Those never seen share as much as the number of those seen weighs (Witten and Bell).
        """
        symbols = symbol_table()
        own = symbols[self.points]
        unseen = np.bincount(symbols, minlength=_SYMBOLS).astype(float)
        seen = np.bincount(own, minlength=_SYMBOLS)
        unseen -= seen
        total = np.bincount(own, self.times, _SYMBOLS) + np.where(unseen > 0, seen, 0)
        # Of a symbol never seen all code points are alike.
        rest = np.where(seen > 0, seen / np.maximum(total, 1.0), 1.0) / np.maximum(unseen, 1.0)
        logs = np.log(rest).astype(np.float32)[symbols]
        logs[self.points] = np.log(self.times / total[own])
        return logs

    def log_probabilities(self, wanted: np.ndarray) -> np.ndarray:
        """log p of the last character of each key of the highest order."""
        out = np.zeros(len(wanted), np.float64)
        left = np.arange(len(wanted))
        for order in range(ORDER, 0, -1):
            mask = np.uint32((1 << (_BITS * order)) - 1)
            key = wanted[left] & mask
            at, hit = _find(self.keys[order - 1], key)
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            at, known = _find(self.contexts[order - 1], key >> np.uint32(_BITS))
            out[left[known]] += self.masses[order - 1][at[known]]
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def train_model(docs: DataFrame, *, text: str = "text") -> CharacterModel:
    """The model of classes: count all texts and interpolate from single symbols up to the highest order."""
    return _model_of_classes(materialise(point_grams(docs, text=text), "ngrams"))


def _model_of_classes(grams: DataFrame) -> CharacterModel:
    found = materialise(symbol_and_point_counts(grams), "symbols")
    counts = [found.where(F.col("key") < _POINTS)]
    for order in range(ORDER, 1, -1):  # continuation counts: in how many different contexts
        counts.insert(0, counts[0].groupBy(_lower("key", order).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    levels = []
    for order, own in enumerate(counts, 1):
        level = _discounted(own, F.shiftright("key", _BITS))
        if order == 1:
            level = level.withColumn("p", F.col("p") + F.col("gamma") / _SYMBOLS)
        else:
            below = levels[-1].select(F.col("key").alias("lower"), F.col("p").alias("lower_p"))
            level = level.withColumn("lower", _lower("key", order)).join(below, "lower")
            level = level.select("key", (F.col("p") + F.col("gamma") * F.col("lower_p")).alias("p"), "gamma")
        levels.append(materialise(level, f"kneser-ney-{order}"))
    arrays: list[list[np.ndarray]] = [[], [], [], []]
    for order, level in enumerate(levels, 1):
        held = level.toArrow()  # bounded by the key space
        key, p, gamma = (held.column(c).to_numpy() for c in ("key", "p", "gamma"))
        ordered = np.argsort(key)
        key, p, gamma = key[ordered], p[ordered], gamma[ordered]
        context, first = np.unique(key >> _BITS, return_index=True)
        if order == 1:  # symbols never seen share the mass left over
            unseen = (gamma[0] if len(gamma) else 1.0) / _SYMBOLS
            whole = np.full(_SYMBOLS, max(unseen, 1e-12))
            whole[key] = p
            key, p = np.arange(_SYMBOLS), whole
        arrays[0].append(key.astype(np.uint32))
        arrays[1].append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        arrays[2].append(context.astype(np.uint32))
        arrays[3].append(np.log(np.maximum(gamma[first], 1e-12)).astype(np.float32))
    seen = found.where(F.col("key") >= _POINTS).toArrow()  # bounded by the number of code points
    points, times = (seen.column(c).to_numpy() for c in ("key", "n"))
    return CharacterModel(*map(tuple, arrays), points - _POINTS, times)


def point_model(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(context, point, log): log p of the last code point of each n-gram of all texts.

    Of each order ``seen`` is what the n-gram and its lower orders give, ``rest`` what the model of
    classes deals out after its context.
    """
    grams = materialise(point_grams(docs, text=text), "ngrams")
    shared = docs.sparkSession.sparkContext.broadcast(_model_of_classes(grams))
    counts = [grams]

    def shorter(order: int) -> Column:
        """The context of an n-gram of ``order`` without its first code point."""
        return F.col("context").bitwiseAND(F.lit((1 << (_POINT_BITS * max(order - 2, 0))) - 1).cast("bigint"))

    for order in range(ORDER, 1, -1):  # continuation counts: in how many different contexts
        less = counts[0].groupBy(shorter(order).alias("context"), "point").agg(F.count(F.lit(1)).alias("n"))
        counts.insert(0, less)
    below = None
    for order, own in enumerate(counts, 1):
        level = _discounted(own, F.col("context"))
        if below is None:
            level = level.withColumnsRenamed({"p": "seen", "gamma": "rest"})
        else:
            lower = below.withColumnsRenamed({"context": "less", "seen": "lower_seen", "rest": "lower_rest"})
            level = level.withColumn("less", shorter(order)).join(lower, ["less", "point"])
            seen, rest = F.col("p") + F.col("gamma") * F.col("lower_seen"), F.col("gamma") * F.col("lower_rest")
            level = level.select("context", "point", seen.alias("seen"), rest.alias("rest"))
        below = level if order == ORDER else materialise(level, f"points-{order}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value.log_shares()
        for batch in batches:
            contexts, points, seen, rest = (batch.column(c).to_numpy() for c in ("context", "point", "seen", "rest"))
            dealt = np.exp(shared.value.log_probabilities(_symbol_keys(contexts, points)) + shares[points])
            logs = pa.array(np.log(np.maximum(seen + rest * dealt, 1e-300)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], logs], ["context", "point", "log"])

    ordered = below.select("context", "point", "seen", "rest").sortWithinPartitions("context", "point")
    return materialise(ordered.mapInArrow(run, "context bigint, point bigint, log double"), "points")


def _pieces(files: list[str]) -> Iterator[list[np.ndarray]]:
    """The table of n-grams, a bounded piece at a time."""
    for path in files:
        system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        with system.open_input_file(place) as source:
            for batch in pq.ParquetFile(source).iter_batches(_PIECE, columns=["context", "point", "log"]):
                yield [c.to_numpy() for c in batch.columns]


def _looked_up(files: list[str], contexts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """log p of n-grams, all of which the table holds."""
    own, keys, which = _merged(contexts, points)
    logs = np.full(len(keys), np.nan)
    for c, p, log in _pieces(files):
        at, hit = _find(own, c)
        place, known = _find(keys, at[hit] << _POINT_BITS | p[hit])
        logs[place[known]] = log[hit][known]
    if np.isnan(logs).any():
        raise ValueError("texts differ from those that the n-grams were counted in")
    return logs[which]


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    window: int = 3
    # Width of the perplexity band on either side of the median, in robust standard deviations.
    band: float = 6.0
    # A language needs this many texts for a band of its own; the others share one band.
    min_texts: int = 200


def text_counts(text: str, window: int) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOL_CHARS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    number: dict[bytes, int] = {}
    repeated = 0
    if len(words) > window:
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        n = len(ids) - window + 1
        code = ids[:n]
        for i in range(1, window):
            # Renumbered after each word, so that no product overflows.
            code = np.unique(code * np.int64(len(number) + 1) + ids[i : n + i], return_inverse=True)[1]
        often = np.nonzero(np.bincount(code)[code] > 1)[0]
        covered = np.zeros(len(ids), bool)
        for i in range(window):
            covered[often + i] = True
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_perplexity double"


def measures(docs: DataFrame, model: DataFrame, rules: QualityRules, *, text: str, beside: dict[str, Column]) -> DataFrame:
    """Counts and mean negative log probability per character of every text, beside the columns named."""
    rows = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[c.alias(n) for n, c in beside.items()]
    )
    files, own = sorted(model.inputFiles()), list(beside)

    def scored(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = _looked_up(files, *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
        start = 0
        for batch, _, points, which, ends in held:
            logs = found[start : start + len(points)][which]
            start += len(points)
            total = np.concatenate(([0.0], np.cumsum(logs)))
            cuts = np.concatenate(([0], ends))
            sums, sizes = total[cuts[1:]] - total[cuts[:-1]], np.diff(cuts)
            ppl = [-s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist())]
            counted = list(zip(*[text_counts(t, rules.window) for t in batch.column("text").to_pylist()]))
            columns = [*[batch.column(n) for n in own], *[pa.array(c, pa.int64()) for c in counted]]
            columns.append(pa.array(ppl, pa.float64()))
            names = [*own, *[c.split()[0] for c in _MEASURES.split(", ")]]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, limit=_SCORED_BYTES):
            contexts, points, which, ends = grams_of(batch.column("text").to_pylist())
            held.append((batch, contexts, points, which.astype(np.uint32), ends))
            size += batch.column("text").nbytes
            if size >= _LOOKED_UP_BYTES:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    schema = StructType([*[rows.schema[n] for n in beside], *StructType.fromDDL(_MEASURES)])
    return rows.mapInArrow(run, schema)


# Bands of more languages than this are joined by a shuffle instead of sent to every task.
MOST_LANGUAGES = 1000
_STEP = 1000  # bins per unit of log perplexity


def bands(measured: DataFrame, rules: QualityRules, lang: str) -> DataFrame:
    """(lang, shared, low, high): limits of log perplexity by language, from binned counts of all
    texts that pass the counting rules. Median and quartiles are those of the bins. Languages with
    ``min_texts`` texts have a row of their own, whatever else the corpus holds; the others share one.
    """
    bins = (
        measured.where("not base_failed and log_perplexity is not null")
        .groupBy(lang, F.floor(F.col("log_perplexity") * _STEP).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Few rows from here on: a language has at most as many bins as there are thousandths.
    enough = F.sum("n").over(Window.partitionBy(lang)) >= rules.min_texts
    own = bins.withColumn("group", F.when(enough, F.struct(F.col(lang).alias("lang"))))
    merged = own.groupBy("group", "bin").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("group").orderBy("bin")
    upto = merged.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("group")))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) / _STEP))

    found = upto.groupBy("group").agg(quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"))
    # 1.349 standard deviations lie between the quartiles of a normal distribution.
    sigma = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(1 / _STEP))
    limits = found.select("group", (F.col("q2") - rules.band * sigma).alias("low"), (F.col("q2") + rules.band * sigma).alias("high"))
    return limits.select("group.lang", F.col("group").isNull().alias("shared"), "low", "high")


def quality_rules(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, perplexity and verdict of every document: one row per input row.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent
    of them inside windows that repeat in the text. ``kept``: not ``base_failed`` and the
    perplexity per character lies within the band of the document's language. Null and empty
    texts have no words, no perplexity and fail. A null language is a language of its own;
    languages with few passing texts share one band. Repeated rows count as
    often as they stand there. Columns named in ``carry`` come along in a struct ``carried``;
    others are not read.
    """
    small_batches(docs.sparkSession)
    model = point_model(docs, text=text)
    beside = {"doc_id": F.col(doc_id), "lang": F.col(lang)}
    if carry:
        beside["carried"] = F.struct(*carry)
    measured = measures(docs, model, rules, text=text, beside=beside)
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    measured = materialise(measured.withColumn("base_failed", failed), "measures")
    limits = materialise(bands(measured, rules, "lang"), "bands")
    own = limits.where("not shared").select(F.col("lang").alias("band_lang"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    if own.count() <= MOST_LANGUAGES:
        own = F.broadcast(own)
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    shared = limits.where("shared").agg(F.first("low").alias("shared_low"), F.first("high").alias("shared_high"))
    joined = joined.crossJoin(F.broadcast(shared))  # one row
    joined = joined.withColumns({"low": F.coalesce("own_low", "shared_low"), "high": F.coalesce("own_high", "shared_high")})
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return joined.select(
        F.col("doc_id").alias(doc_id),
        *[c.split()[0] for c in _MEASURES.split(", ")[:-1]],
        "base_failed",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("low").alias("perplexity_low"),
        F.exp("high").alias("perplexity_high"),
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        *(["carried"] if carry else []),
    )
