"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .audit import ORACLE as AUDIT_ORACLE
from .audit import audit_documents
from .bpe import encode_documents
from .caps import embedding_groups
from .frames import read_token_files, token_folder, write_token_files
from .licenses import oracle as license_oracle
from .licenses import scan_licenses
from .minhash import fingerprint_documents
from .mixing import mix
from .passages import repeated_passages
from .perplexity import quality_rules
from .ranking import rank_quality
from .sharding import shard_documents
from .simhash import simhash_groups

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

# SQL that gives the same rows, where SQL can express the operator.
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_registry)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings, at a cosine of 0.98 within a label."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document under the many-language ranks, and what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), ranks, with_ids=False)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 4-word SimHash, at most 4 bits apart."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document, and where the base phrases stand."""
    return scan_licenses(table(spark, sf_dir, "documents"))


ORACLE["op4_licenses"] = license_oracle()


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds too, one row each."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.*").withColumnRenamed("other", "other_doc_id")


@query
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)


@query
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture of sources takes."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "merit", "chance", "taken")


_MIXTURE = r"""
with counted as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5::double)
           / 4503599627370496::double as draw
  from documents),
rows as (
  select *, cast(1 + (size >= 50)::int + (size >= 200)::int + (size >= 1000)::int as bigint) as merit from counted),
sizes as (
  select source, cast(sum(size) as bigint) as source_size, 3 * cast(sum(size) as bigint) as fill,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from rows group by source),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(fill) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from sizes
  window before as (order by fill / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select *, case when fill < level * weight then fill::double
                 else max(case when fill >= level * weight then level end) over () * weight end as target
  from levels),
merits as (
  select source, merit, cast(sum(size) as bigint) as words, cast(sum(size) as bigint) * merit as shares from rows group by source, merit),
merit_levels as (
  select m.*, t.source_size, t.target,
         (t.target - 3 * coalesce(sum(words) over above, 0)::double)
           / nullif(sum(shares) over (partition by m.source) - coalesce(sum(shares) over above, 0), 0)::double as level
  from merits m join targets t on m.source is not distinct from t.source
  window above as (partition by m.source order by merit desc rows between unbounded preceding and 1 preceding)),
expectations as (
  select *, case when level * merit >= 3 then 3::double
                 else coalesce(max(case when level * merit < 3 then level end) over (partition by source) * merit, 0) end as expected
  from merit_levels),
plan as (
  select source, merit, source_size, target, floor(expected) as whole, expected - floor(expected) as chance,
         target - sum(floor(expected) * words) over (partition by source) as wanted
  from expectations),
ranked as (
  select r.doc_id, r.size, r.merit, p.source, p.source_size, p.target, p.whole, p.wanted, p.chance,
         case when p.chance > 0 then r.draw / (1 - r.draw) * ((1 - p.chance) / p.chance) end as odds
  from rows r join plan p on r.source is not distinct from p.source and r.merit = p.merit),
fill0 as (select *, 0 as more, wanted as rest from ranked)
"""

# Once: documents in order while they fit; after the first time those that fit by themselves.
_FILL = """,
run{i} as (
  select *, sum(case when open then size else 0 end) over (
      partition by source order by floor(odds / (1 + odds) * 4503599627370496), doc_id) as upto
  from (select *, odds is not null and more = 0 and size > 0 and rest >= 1{fits} as open from fill{i})),
more{i} as (
  select * replace (case when open and (upto <= floor(rest){last}) then 1 else more end as more) from run{i}),
fill{next} as (
  select * exclude (open, upto) replace (wanted - coalesce(sum(size) filter (more = 1) over (partition by source), 0) as rest)
  from more{i})"""

ORACLE["op7_mixture"] = (
    _MIXTURE
    + _FILL.format(i=0, next=1, fits="", last="")
    + _FILL.format(i=1, next=2, fits=" and size <= rest", last="")
    + _FILL.format(
        i=2, next=3, fits=" and size <= rest", last=" or upto - size <= floor(rest) and 2 * (rest - (upto - size)) >= size"
    )
    + " select doc_id, size, source_size, target, merit, chance, cast((whole + more) * size as bigint) as taken from fill3"
)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op9_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from preference pairs of labelled ones."""
    return rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into frame files in order of doc_id, and read back from them."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer, token_folder(spark)))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizations of every document."""
    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_documents(table(spark, sf_dir, "documents"), *paths)


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike neighbours are."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in all orders."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = AUDIT_ORACLE
