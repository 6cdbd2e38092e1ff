"""Documents to training tokens: quality, near-duplicates, repeated passages, mixture, ids.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns what it
keeps, with the columns of ``documents`` (the last one returns tokens). ``run`` writes every
stage to the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.mixing import mix
from tidemark.llm.passages import remove_passages
from tidemark.llm.perplexity import quality_rules
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.texts import unused
from tidemark.session import materialise

# Perplexity, SimHash, chaining and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or lie outside their language's perplexity go."""
    return quality_rules(docs, carry=tuple(docs.columns)).where("kept").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.

    Of rows that repeat this id one stays. Rows without an id cannot be told apart and stay.
    """
    kept = simhash_groups(docs, shingle=4, max_bits=4).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    # The join has brought the rows of an id together already.
    place = unused("place", docs)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    rows = rows.withColumn(place, first).where(F.col(place) == 1).select(*[f"`{c}`" for c in docs.columns])
    return rows.unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones."""
    return remove_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture of sources takes."""
    taken = mix(docs, carry=tuple(docs.columns)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what the mixture took."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", passages),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
