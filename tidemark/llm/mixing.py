"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .splitters import splitters

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
# Word counts from which a document is wanted twice, three and four times as much as a short one.
MERIT_STEPS = (50, 200, 1000)
# Merits are whole numbers up to this, which bounds the plan to so many rows a source.
MOST_MERIT = 255
_GRID = 1 << 52


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): target words of each source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the words of
    all. A target stops at ``most`` times its source's size; what is over goes to the others
    by weight until none is above. That is a water level: with sources in order of the level
    that fills them, each is full if the level that the rest of the words would reach over it
    and all after it lies above.
    """
    everything = Window.partitionBy(F.lit(0))  # one row per source
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("full", most * F.col("source_size"))
    filling = everything.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", rest / open_weight)
    filled = F.col("full") < F.col("level") * F.col("weight")
    level = level.withColumn("open_level", F.when(~filled, F.col("level")))
    reached = F.max("open_level").over(everything)
    target = F.when(F.col("open_level").isNull(), F.col("full").cast("double")).otherwise(reached * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (number.cast("double") + 0.5) / _GRID


def expected_copies(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, merit, source_size, target, whole, chance, wanted) from words per source and merit.

    ``sizes``: (source, merit, words). Within a source a document expects copies in proportion
    to its merit, but never more than ``most``; what is over goes to the lower merits in
    proportion, so that expected words add up to the target. ``whole`` copies are certain,
    ``chance`` is the probability of one more, ``wanted`` the words of a source that those are
    to fill. Merit zero expects nothing.
    """
    targets = source_targets(sizes.groupBy("source").agg(F.sum("words").cast("bigint").alias("source_size")), most)
    targets = targets.withColumnRenamed("source", "target_source")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    in_source = Window.partitionBy("source")  # a row per merit
    above = in_source.orderBy(F.col("merit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shares = F.col("merit") * F.col("words")
    left = F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))
    over = F.sum(shares).over(in_source) - F.coalesce(F.sum(shares).over(above), F.lit(0))
    # Copies a unit of merit gets if all higher merits are at the limit. The limit holds for a
    # first few merits; the level of the first one below it is the highest of those below it.
    rows = rows.withColumn("level", left / F.nullif(over, F.lit(0)))
    limited = F.col("level") * F.col("merit") >= most
    rows = rows.withColumn("open_level", F.max(F.when(~limited, F.col("level"))).over(in_source))
    expected = F.when(F.col("merit") == 0, F.lit(0.0)).when(limited, F.lit(float(most)))
    expected = expected.otherwise(F.coalesce(F.col("open_level") * F.col("merit"), F.lit(0.0)))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("int"))
    wanted = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(in_source)
    return rows.select(
        "source", "merit", "source_size", "target", "whole", (F.col("expected") - F.col("whole")).alias("chance"), wanted.alias("wanted")
    )


def mix(
    docs: DataFrame,
    *,
    seed: int = 7,
    most: int = MOST_COPIES,
    fills: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    merit_steps: Sequence[int] = MERIT_STEPS,
    desirability: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mixture takes each document: one row per input row.

    A document expects copies in proportion to its merit: one more than the number of
    ``merit_steps`` that its words reach, or a column named by ``desirability`` (a whole number,
    at most 255; null or below zero counts as zero and is never taken). The whole part is taken
    for certain, the fraction is the probability of one more copy. Those copies are drawn in
    Pareto order: by the odds of a random number over the odds of inclusion, smallest first.
    Documents are taken while they fit into the words their source still wants; what then is
    left is filled ``fills - 1`` more times from the documents behind that fit into it, so a
    source ends within a fraction of a document of its target. The cuts are found by repeated
    histograms; no source is sorted.

    Columns: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``merit``, ``chance`` (of
    a copy beyond the certain ones), ``copies``, ``taken`` (words) and, in a struct ``carried``,
    those named in ``carry``. A null text has no words; null sources are one source, the last;
    rows that repeat an id are drawn apart, in order of input. An empty table gives an empty
    one. A source whose documents all have merit zero gives nothing.
    """
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words.alias("size"),
        *([F.round(F.col(desirability).cast("double")).alias("wish")] if desirability else []),
        uniform(F.col(doc_id), seed).alias("draw"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    if desirability:
        merit = F.least(F.greatest(F.coalesce("wish", F.lit(0.0)), F.lit(0.0)), F.lit(float(MOST_MERIT))).cast("bigint")
    else:
        merit = sum((F.when(F.col("size") >= step, 1).otherwise(0) for step in merit_steps), F.lit(1)).cast("bigint")
    rows = materialise(rows, "mixture-rows").withColumn("merit", merit)
    sizes = rows.groupBy("source", "merit").agg(F.sum("size").alias("words"))
    plan = expected_copies(materialise(sizes, "source-sizes"), most)
    plan = materialise(plan.withColumnsRenamed({"source": "plan_source", "merit": "plan_merit"}), "mixture-plan")
    planned = F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("merit") == F.col("plan_merit"))
    ranked = rows.join(plan, planned)
    odds = F.col("draw") / (1 - F.col("draw")) * F.try_divide(1 - F.col("chance"), F.col("chance"))
    # Ranks are the odds mapped to whole numbers; no rank: never.
    rank = F.when(F.col("chance") > 0, F.floor(odds / (1 + odds) * _GRID).cast("bigint"))
    ranked = ranked.withColumn("rank", rank).select("row", "source", "rank", "size")
    ranked = materialise(ranked.withColumn("more", F.lit(0)), "mixture-ranks")
    sources = plan.select("plan_source", "wanted").distinct()
    wanted = sources.select(F.col("plan_source").alias("left_source"), F.col("wanted").alias("left"))
    for number in range(fills):
        ranked = _fill(ranked, wanted, first=number == 0, last=number == fills - 1)
        if number < fills - 1:
            filled = ranked.where("more = 1").groupBy("source").agg(F.sum("size").alias("filled"))
            wanted = sources.join(filled, F.col("plan_source").eqNullSafe(F.col("source")), "left").select(
                F.col("plan_source").alias("left_source"), (F.col("wanted") - F.coalesce("filled", F.lit(0))).alias("left")
            )
    out = rows.join(plan, planned).join(ranked.select("row", "more"), "row")
    copies = (F.col("whole") + F.col("more")).cast("int")
    return out.select(
        F.col("doc_id").alias(doc_id),
        "size",
        "source_size",
        "target",
        "merit",
        "chance",
        copies.alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"),
        *(["carried"] if carry else []),
    )


def _fill(ranked: DataFrame, wanted: DataFrame, first: bool, last: bool) -> DataFrame:
    """Take documents in order of rank while they fit into what is left of their source.

    After the first time only those are looked at that fit by themselves. The last time the
    document that no longer fits is taken too if at least half of it does.
    """
    wanted = materialise(wanted.where("left >= 1"), "mixture-left")
    joined = ranked.join(wanted, F.col("source").eqNullSafe(F.col("left_source")), "left")
    open_rows = F.col("rank").isNotNull() & (F.col("more") == 0) & (F.col("size") > 0) & F.col("left").isNotNull()
    if not first:
        open_rows = open_rows & (F.col("size") <= F.col("left"))
    joined = materialise(joined.withColumn("open", open_rows).drop("left_source"), "mixture-open")
    targets = wanted.select(
        F.col("left_source").alias("source"), F.lit(0).alias("target_id"), F.floor("left").cast("bigint").alias("target")
    )
    cut = splitters(joined.where("open").select("source", "rank", "row", "size"), targets, "source", ["rank", "row"], "size")
    cut = cut.select(F.col("source").alias("cut_source"), F.col("rank").alias("cut_rank"), F.col("row").alias("cut_row"), "below")
    joined = joined.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    before = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("row") < F.col("cut_row")))
    # Without a cut everything that is open fits.
    taken = F.col("below").isNull() | before
    if last:
        at = (F.col("rank") == F.col("cut_rank")) & (F.col("row") == F.col("cut_row"))
        taken = taken | (at & (2 * (F.col("left") - F.col("below")) >= F.col("size")))
    more = F.when(F.col("open") & taken, 1).otherwise(F.col("more"))
    return materialise(joined.select("row", "source", "rank", "size", more.alias("more")), "mixture-ranks")
