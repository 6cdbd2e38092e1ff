"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .texts import as_bytes, narrow, slices

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "same_as_last", "repeated_pairs", "line_words", "repeated_lines",
    "upper", "upper_words", "digits", "marks", "symbols", "symbol_words", "bars", "shouts", "spaces", "not_ascii",
    "sentence_ends",
)

_CLASS = np.zeros(256, np.int64)  # 0 lower-case letter or rest of ASCII
for _kind, _members in enumerate((range(65, 91), range(48, 58), b"#*$%&<>@^~\\", b"|", b"!", b" \t\n\x0b\x0c\r", range(128, 256), b".?", b",;:'\"()-[]{}/=+_`"), 1):
    for _c in _members:
        _CLASS[_c] = _kind
_SYMBOLS = b"#*$%&<>|"


def features_of(text: bytes) -> list[float]:
    """Numbers that describe one text, in the order of ``FEATURES``; an empty text is all zero."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10) / size
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    pairs = set(zip(words, words[1:]))
    tail = [w[-1] in _SYMBOLS for w in words]
    return [
        math.log1p(n),
        min(sum(map(len, words)) / n, 50.0) / 10,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0,
        min(n / len(lines), 200.0) / 100,
        1 - len(set(lines)) / len(lines),
        kinds[1],
        sum(w.isupper() for w in words) / n,
        kinds[2],
        kinds[9],
        kinds[3],
        sum(tail) / n,
        kinds[4],
        kinds[5],
        kinds[6],
        kinds[7],
        kinds[8],
    ]


def text_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features) of every row."""
    rows = narrow(docs, text=text, doc_id=doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([features_of(t) for t in as_bytes(batch.column(text))], np.float64)
            cuts = pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), lists], ["doc_id", "features"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[doc_id].dataType.simpleString()}, features array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label of which is learned from: crc32 of the id as text leaves 2 modulo 4."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


@dataclass(frozen=True)
class RankingParams:
    # Labelled rows of each class that pairs are drawn from, in order of a hash of the id, and
    # pairs per row of the smaller class.
    rows_per_class: int = 20_000
    pairs_per_row: int = 8
    penalty: float = 1e-4
    # What a text at the threshold quantile scores.
    threshold_score: float = 0.7


def preference_pairs(labelled: DataFrame, params: RankingParams) -> DataFrame:
    """(difference, label): feature differences of a better and a worse text, either way round.

    ``labelled`` has doc_id, features, quality. Both classes are numbered by hash into as many
    cells as there are better texts, so each worse text meets about ``pairs_per_row`` of them.
    """
    sizes = dict(labelled.groupBy("quality").count().collect())
    good = labelled.where("quality = 1")
    bad = labelled.where("quality = 0")
    cells = max(1, min(sizes.get(1, 0), params.rows_per_class))
    share = {q: min(1.0, params.rows_per_class / max(1, sizes.get(q, 0))) for q in (0, 1)}

    def chosen(df: DataFrame, q: int) -> DataFrame:
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
        return df.where(draw < share[q])

    def cell(j: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", j), F.lit(cells))

    better = chosen(good, 1).select(cell(F.lit(-1)).alias("cell"), F.col("features").alias("better"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(params.pairs_per_row - 1)))
    worse = chosen(bad, 0).select("doc_id", F.col("features").alias("worse"), turns.alias("turn"))
    worse = worse.select(cell(F.col("turn")).alias("cell"), "worse", (F.xxhash64("doc_id", "turn") % 2 == 0).alias("forward"))
    pairs = better.join(worse, "cell")
    sign = F.when(F.col("forward"), 1.0).otherwise(-1.0)
    difference = F.zip_with("better", "worse", lambda x, y: (x - y))
    return pairs.select(
        F.transform(difference, lambda d: d * sign).alias("difference"), F.col("forward").cast("double").alias("label")
    )


def fit_weights(labelled: DataFrame, params: RankingParams) -> list[float] | None:
    """Weights of the Bradley-Terry scores, or None unless both classes are there.

    The chance that the first of a pair is the better one is the logistic of the difference of
    scores, so the fit is a logistic regression of feature differences without intercept.
    """
    pairs = materialise(preference_pairs(labelled, params), "preference-pairs")
    if pairs.select("label").distinct().count() < 2:
        return None
    data = pairs.select(array_to_vector("difference").alias("features"), "label")
    fit = LogisticRegression(fitIntercept=False, regParam=params.penalty, maxIter=100, standardization=True).fit(data)
    return [float(w) for w in fit.coefficients]


def rank_quality(
    docs: DataFrame,
    labels: DataFrame,
    params: RankingParams = RankingParams(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    quality: str = "quality",
) -> DataFrame:
    """Quality score of every document: one row per input row, empty and null texts included.

    Columns: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score is at
    least ``threshold_score``). The threshold is a quantile of the learned scores: the share of
    worse texts among the labelled ones that are learned from. Only texts are scored; labels of held-out
    ids are not read. Null labels, ids with both labels and labels without a document are left
    out; repeated labels count once. Without both classes every score is 0.5.
    """
    found = materialise(text_features(docs, doc_id=doc_id, text=text), "features")
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(quality).cast("int").alias("quality"))
    known = known.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")
    )
    labelled = found.join(known.where("quality = most").select("doc_id", "quality"), "doc_id")
    labelled = materialise(labelled, "labelled")
    weights = fit_weights(labelled, params)
    if weights is None:
        score = F.lit(0.5)
    else:
        raw = sum((F.col("features")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
        worse = F.avg((F.col("quality") == 0).cast("double"))
        share = labelled.agg(worse).first()[0]
        # Scores lie on a grid of thousandths for the quantile, so that it needs only counts.
        binned = labelled.groupBy(F.floor(raw * 1000).cast("bigint").alias("bin")).count()
        cut = _quantile(binned, share) / 1000
        score = 1 / (1 + F.exp(-(raw - cut) - math.log(params.threshold_score / (1 - params.threshold_score))))
    return found.select(
        F.col("doc_id").alias(doc_id),
        held_out().alias("held_out"),
        score.alias("score"),
        (score >= params.threshold_score).cast("int").alias("predicted"),
    )


def _quantile(bins: DataFrame, share: float) -> int:
    """Bin that the given share of rows lies below; scanned range by range on the cluster."""
    return bins.agg(F.percentile("bin", F.lit(share), F.col("count"))).first()[0]
