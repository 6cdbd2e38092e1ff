"""Interaction of five filters: who removes what, in every order they can be applied in.

A document becomes a 32-bit word with one bit per subset of the filters, set when the document
survives that subset. Adding the words up bit by bit gives the survivors of all 32 subsets at
once, and any order of filters only walks through subsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
_ALL = (1 << SUBSETS) - 1
# Texts that hold more than this share of all rows are looked up in a broadcast table; there
# can be no more than a thousand of them.
_HEAVY_PARTS = 1000


def survival_word(failures: Sequence[Column]) -> Column:
    """Bit s is set when none of the filters in subset s (bit i: filter i) fails the row."""
    word = F.lit(_ALL)
    for i, fails in enumerate(failures):
        without = sum(1 << s for s in range(SUBSETS) if not s >> i & 1)
        word = word.bitwiseAND(F.when(fails, F.lit(without)).otherwise(F.lit(_ALL)))
    return word


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save addition.

    Three words of equal weight become one of this weight (their sum without carry) and one of
    twice the weight (the carries) until at most two of each weight are left to be read bit by bit.
    """
    counts = np.zeros(SUBSETS, np.int64)
    column, weight = words.astype(np.uint32, copy=False), 1
    while len(column):
        carries = []
        while len(column) > 2:
            third = len(column) // 3
            a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            column = np.concatenate((half ^ c, column[3 * third :]))
        counts += weight * ((column[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
        column, weight = np.concatenate(carries) if carries else column[:0], 2 * weight
    return counts


def subset_survivors(rows: DataFrame) -> DataFrame:
    """Survivors of all subsets per part and label.

    ``rows``: ``part``, ``label`` (int), ``word``. Result: ``part``, ``label``, ``s0`` to
    ``s31``. Words are added up per batch inside the tasks, so that only one row per batch,
    part and label reaches the sums.
    """
    names = [f"s{s}" for s in range(SUBSETS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.dictionary_encode(batch.column("part"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 8 | label
            words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            counts = np.stack([positional_counts(w) for w in np.split(words[order], starts[1:])])
            columns = [parts.dictionary.take(pa.array(keys >> 8)), pa.array((keys & 255).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts.T)], ["part", "label", *names])

    schema = "part string, label int, " + ", ".join(f"{n} bigint" for n in names)
    counted = rows.select("part", "label", "word").mapInArrow(run, schema)
    return counted.groupBy("part", "label").agg(*[F.sum(n).alias(n) for n in names])


def audit(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``subset_survivors``.

    Labels are bit sets: 1 stands for good, 2 for toxic documents. Columns: ``part``,
    ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley``.
    """

    def sums(bit: int) -> str:
        value = f"if(label & {bit} > 0, s{{s}}, 0)" if bit else "s{s}"
        return "array(" + ", ".join(f"sum({value.format(s=s)})" for s in range(SUBSETS)) + ")"

    named = {"n": 0, "good": 1, "toxic": 2}
    parts = survivors.groupBy("part").agg(*[F.expr(sums(bit)).alias(name) for name, bit in named.items()])
    # Of the 120 orders |T|! (4 - |T|)! have exactly the filters of T before a given one.
    last = len(LETTERS) - 1
    weight = [factorial(k) * factorial(last - k) for k in range(len(LETTERS))]
    shares = []
    for i in range(len(LETTERS)):
        before = [s for s in range(SUBSETS) if not s >> i & 1]
        shares.append(" + ".join(f"{weight[s.bit_count()]} * (n[{s}] - n[{s | 1 << i}])" for s in before))
    orders = F.lit(["".join(p) for p in permutations(LETTERS)])
    steps = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    rows = parts.withColumn("shares", F.expr(f"array({', '.join(shares)})")).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))

    def place(letter: str) -> str:
        return f"instr('{LETTERS}', {letter}) - 1"

    prefix = "substring(filter_order, 1, step - 1)"
    before = f"aggregate(filter(split({prefix}, ''), c -> c != ''), 0, (m, c) -> m | shiftleft(1, {place('c')}))"
    rows = rows.withColumn("place", F.expr(place("substring(filter_order, step, 1)"))).withColumn("before", F.expr(before))
    rows = rows.withColumn("own", F.expr("shiftleft(1, place)")).withColumn("after", F.expr("before | own"))
    return rows.selectExpr(
        "part",
        "filter_order",
        "step",
        "n[after] as kept",
        "n[before] - n[after] as removed",
        "n[0] - n[own] - (n[before] - n[after]) as redundant",
        f"n[{SUBSETS - 1} - own] - n[{SUBSETS - 1}] as unique_fails",
        "good[before] - good[after] as good_lost",
        "toxic[before] - toxic[after] as toxic_lost",
        "shares[place] as shapley",
    )


def _repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id``, ``digest``) with ``repeat``: a smaller id holds the same text."""
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    copies = materialise(copies.where("copies > 1"), "copied-texts")
    share = rows.count() // _HEAVY_PARTS
    heavy = F.broadcast(copies.where(F.col("copies") > share).drop("copies"))  # under 1,000 rows
    light = copies.where(F.col("copies") <= share).drop("copies")
    found = rows.join(heavy, "digest").unionByName(
        rows.join(heavy.drop("first_id"), "digest", "left_anti").join(light, "digest", "left"), allowMissingColumns=True
    )
    return found.withColumn("repeat", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("digest", "first_id")


def document_filters(
    docs: DataFrame,
    labels: DataFrame,
    *,
    min_words: int = 200,
    min_distinct_percent: int = 50,
    max_capital_percent: int = 2,
    symbols: str = "#$%&*|",
) -> DataFrame:
    """Survival words of documents under the five filters: ``part``, ``label``, ``word``.

    Failing is: A, fewer than ``min_words`` words; B, fewer distinct words than that share of
    the words; C, more capitals A-Z than that share of the characters; D, one of ``symbols``; E,
    the text of a smaller doc_id anywhere in the table. A null text is an empty one, a null
    source the part ''. A null id is smaller than none and has no smaller one; rows that share id
    and text are no repeats of each other. An id counts as good (toxic) when any of its rows in
    ``labels`` says 1. Other columns of both tables are not read; empty tables give empty ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    some = "[" + "".join(f"\\{c}" for c in symbols) + "]"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words).select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.size("words") < min_words).alias("a"),
        (100 * F.size(F.array_distinct("words")) < min_distinct_percent * F.size("words")).alias("b"),
        (100 * capitals > max_capital_percent * F.length("text")).alias("c"),
        F.col("text").rlike(some).alias("d"),
    )
    rows = _repeats(materialise(rows, "filter-flags"))  # the texts are read once
    told = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    told = told.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic")
    )
    rows = rows.join(told.select("doc_id", (F.col("good") + F.col("toxic")).alias("label")), "doc_id", "left")
    word = survival_word([F.col(c) for c in ("a", "b", "c", "d", "repeat")])
    return rows.select("part", F.coalesce("label", F.lit(0)).alias("label"), word.alias("word"))


def audit_documents(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The audit of ``document_filters``, one row per part, order and step."""
    return audit(subset_survivors(document_filters(docs, labels, **limits)))


ORACLE = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
flags as (
  select doc_id, part,
         (len(words) < 200)::int
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
         + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int
         + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as fails
  from d),
told as (
  select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic
  from labels where doc_id is not null group by doc_id),
counts as (
  select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from flags left join told using (doc_id) group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bit as own, coalesce(sum(bit) over before, 0)::int as done
  from (select filter_order, i as step, substr(filter_order, i, 1) as l from orders, range(1, 6) r(i)) join letters using (l)
  window before as (partition by filter_order order by step rows between unbounded preceding and 1 preceding)),
found as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (fails & (done | own) = 0), 0) as kept,
         coalesce(sum(n) filter (fails & done = 0 and fails & own > 0), 0) as removed,
         coalesce(sum(n) filter (fails & done > 0 and fails & own > 0), 0) as redundant,
         coalesce(sum(n) filter (fails = own), 0) as unique_fails,
         coalesce(sum(good) filter (fails & done = 0 and fails & own > 0), 0) as good_lost,
         coalesce(sum(toxic) filter (fails & done = 0 and fails & own > 0), 0) as toxic_lost
  from counts, steps group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from found
"""
