import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, difference
from tidemark.llm.perplexity import quality_rules
from tidemark.llm.pretokenize import read_ranks
from tidemark.llm.simhash import simhash_groups
from tidemark.session import materialise

NAMES = [
    "op1_caps", "op2_byte_bpe", "op3_simhash", "op4_licenses", "op5_passages", "op6_shards", "op7_mixture", "op8_quality",
    "op9_ranking", "op10_token_files", "op11_alignment", "op12_fingerprints", "op13_filter_audit", "pipeline",
]


def test_all_queries_are_registered():
    assert set(NAMES) <= set(queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_passages", "mixture", "tokens",
    ]


@pytest.mark.parametrize("name", ["op4_licenses", "op7_mixture", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert difference(queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["op1_caps", "op3_simhash", "op6_shards", "op8_quality", "op9_ranking", "op10_token_files", "op11_alignment", "op12_fingerprints"])
def test_queries_return_every_row_once(spark, sf_dir, name):
    of, key = ("embeddings", "vec_id") if name == "op1_caps" else ("documents", "doc_id")
    expected = spark.read.parquet(f"{sf_dir}/{of}.parquet").select(key).toPandas()[key]
    assert sorted(queries()[name](spark, sf_dir).toPandas()[key]) == sorted(expected)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialise(stage(spark, kept[-1], sf_dir), name))
        assert kept[-1].columns == columns and kept[-1].dtypes == docs.dtypes
    rows = [{r["doc_id"]: r for r in df.collect()} for df in kept]
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    assert rows[1] == {i: r for i, r in rows[0].items() if verdict[i]}
    group = {r["doc_id"]: r["component_id"] for r in simhash_groups(kept[1], shingle=4, max_bits=4).collect()}
    assert rows[2] == {i: r for i, r in rows[1].items() if group[i] == i}
    assert set(rows[3]) <= set(rows[2])
    changed = [i for i in rows[3] if rows[3][i]["text"] != rows[2][i]["text"]]
    assert all(rows[3][i]["n_chars"] == len(rows[3][i]["text"]) < rows[2][i]["n_chars"] for i in changed)
    assert set(rows[4]) <= set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[4])
    copies = kept[4].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 3

    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={},
    )
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in kept[4].select("doc_id").collect())
    for r in last:
        text = rows[4][r["doc_id"]]["text"]
        assert r["ids"] == encoding.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_an_empty_table_goes_through(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_go_through(spark, sf_dir, tmp_path):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=random.randrange(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(random.choices(words, k=n))

    twice, long = prose(90), prose(60000)
    rows = [(i, prose(random.randrange(60, 120)), "en", "s") for i in range(40)]
    rows += [(50, twice, "en", "s"), (50, twice, "en", "s"), (51, twice, "en", "t"), (None, prose(80), None, None), (None, None, "en", "s")]
    rows += [(60, None, "en", "s"), (61, "", "en", None), (62, "short", "en", "t"), (63, long, "en", "t"), (64, prose(70), None, None)]
    schema = "doc_id bigint, text string, lang string, source string"
    made = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as bigint) as n_chars", "'x' as kept", "1 as copies", "2 as size")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        assert docs.dtypes == before.dtypes
        ids.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=repr))
    kept = [*range(40), 63, 64]
    assert ids[0] == sorted([*kept, 50, 50, 51, None], key=repr)
    assert ids[1] == ids[2] == sorted([*kept, 50, None], key=repr)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted((r["doc_id"] for r in last.collect()), key=repr) == ids[3] and set(ids[3]) <= {*kept, 50, None}


def test_stages_leave_columns_of_any_name_alone(spark, documents):
    """Names that the stages use themselves, or used once, as columns of the documents."""
    words = [f"word{i}" for i in range(400)]
    random.seed(11)
    shared = " ".join(random.choices(words, k=60))
    rows = [(i, f"{' '.join(random.choices(words, k=80))} {shared if i % 5 == 0 else ''}", "en", "s") for i in range(20)]
    rows += [(100, rows[1][1], "en", "s"), (100, rows[1][1], "en", "s"), (None, rows[2][1], "en", "s")]
    docs = documents(rows)
    for c in ("left_text", "__doc", "_doc", "__first", "_place", "place_", "PASSAGES"):
        if c.lower() not in {x.lower() for x in docs.columns}:
            docs = docs.selectExpr("*", f"'kept' as `{c}`")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.passages):
        found = stage(spark, docs, None)
        assert found.columns == docs.columns
        got = found.collect()
        assert got and all(r["left_text"] == r["__first"] == r["__doc"] == "kept" for r in got)
