import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidemark import Settings, land_raw, read_loans, resolve_source, stratified_sample, validate_source
from tidemark.session import materialise, work_dir
from tidemark.sources import exports, integrity, loans, readers

HEADER = ",".join(readers.REQUIRED_COLUMNS)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture
def csv(tmp_path):
    return write(
        tmp_path / "raw" / "loans.csv",
        f"{HEADER},int_rate\n"
        '1,Dec-2015,1000,1.5,500,700,1,10+ years,car,RENT,CA,900xx,0,"My, loan","two\nlines ""quoted""",9.5\n'
        "2,soon,abc,,500,700,1,,car,RENT,CA,900xx,1,,,9.5\n",
    )


def test_csv_with_line_breaks_and_junk(spark, csv):
    one, two = read_loans(spark, csv).orderBy("id").collect()
    assert one["desc"] == 'two\nlines "quoted"' and one["title"] == "My, loan"
    assert (one["revenue"], one["Default"], one["int_rate"]) == (1000.0, 0, "9.5")
    assert two["revenue"] is None and two["dti_n"] is None and two["emp_length"] is None and two["desc"] is None


def test_columns_are_matched_by_name(spark, tmp_path):
    names = list(reversed(readers.REQUIRED_COLUMNS))
    line = {"id": "7", "issue_d": "Jan-2010", "Default": "1", "loan_amnt": "10"}
    path = write(tmp_path / "x.csv", ",".join(names) + "\n" + ",".join(line.get(c, "") for c in names) + "\n")
    row = read_loans(spark, path).first()
    assert (row["id"], row["Default"], row["loan_amnt"]) == (7, 1, 10.0)
    assert dict(readers.read_csv(spark, path, infer=True).dtypes)["id"] == "int"


def test_landing_adds_the_date_and_is_kept(spark, csv, tmp_path):
    settings = Settings(root=str(tmp_path))
    out = land_raw(spark, settings)
    landed = read_loans(spark, out)
    assert [str(d) for (d,) in values(landed, "issue_date")] == ["None", "2015-12-01"]
    stamp = (tmp_path / "raw" / "loans_raw.parquet" / "_SUCCESS").stat().st_mtime_ns
    land_raw(spark, settings)
    assert (tmp_path / "raw" / "loans_raw.parquet" / "_SUCCESS").stat().st_mtime_ns == stamp
    land_raw(spark, settings, force=True)
    assert (tmp_path / "raw" / "loans_raw.parquet" / "_SUCCESS").stat().st_mtime_ns > stamp
    assert any(".zstd." in p.name for p in (tmp_path / "raw" / "loans_raw.parquet").iterdir())


def test_source_is_explicit_then_landed_then_sample(spark, raw, tmp_path):
    settings = Settings(root=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        resolve_source(spark, None, settings)
    exports.export_csv(stratified_sample(raw, 5), settings.sample_csv, single_file=True)
    assert resolve_source(spark, None, settings) == settings.sample_csv
    raw.limit(3).write.parquet(settings.raw_parquet)
    assert resolve_source(spark, None, settings) == settings.raw_parquet
    assert resolve_source(spark, settings.sample_csv, settings) == settings.sample_csv
    with pytest.raises(FileNotFoundError):
        resolve_source(spark, str(tmp_path / "nothing"), settings)


def test_ordered_export_reads_back_equal(spark, raw, tmp_path):
    plain = raw.drop("issue_date")
    exports.export_csv(plain, str(tmp_path / "many.csv"))
    back = readers.read_csv(spark, str(tmp_path / "many.csv"))
    blank_is_null = {c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in ("title", "desc")}
    left, right = (d.withColumns(blank_is_null).drop("revenue", "dti_n", "fico_n") for d in (plain, back))
    assert left.exceptAll(right.select(left.columns)).isEmpty() and back.count() == plain.count()
    exports.export_csv(plain.select("id"), str(tmp_path / "one.csv"), single_file=True)
    files = [p for p in (tmp_path / "one.csv").iterdir() if p.suffix == ".csv"]
    ids = [int(line) for line in files[0].read_text().split()[1:]]
    assert len(files) == 1 and ids == sorted(ids) and len(ids) == plain.count()


def test_validation(raw):
    good = validate_source(raw).first()
    assert good["valid"] and good["missing_columns"] == [] and good["n_rows"] == raw.count()
    assert validate_source(raw.drop("zip_code")).first()["missing_columns"] == ["zip_code"]
    assert not validate_source(raw.limit(0)).first()["valid"]
    bad = raw.withColumn("Default", F.when(F.col("id") == 3, 2).otherwise(F.col("Default")))
    assert validate_source(bad).first()["bad_targets"] == 1


def test_manifest(spark, tmp_path):
    folder = tmp_path / "files"
    for name, text in {"a.csv": "hello", "b.csv": "world", "c.csv": "three", "e.csv": "extra"}.items():
        write(folder / name, text)
    manifest = integrity.file_manifest(spark, str(folder), "[abc].csv")
    assert {r["file"]: r["md5"] for r in manifest.collect()}["a.csv"] == hashlib.md5(b"hello").hexdigest()
    kept = spark.createDataFrame([*manifest.collect(), ("d.csv", 3, "x")], manifest.schema)
    integrity.require_manifest(spark, str(folder), kept.where("file <> 'd.csv'"))
    write(folder / "b.csv", "w0rld")
    write(folder / "c.csv", "longer")
    found = dict(tuple(r) for r in integrity.check_manifest(spark, str(folder), kept).collect())
    assert found == {"a.csv": "ok", "b.csv": "wrong_md5", "c.csv": "wrong_size", "d.csv": "missing", "e.csv": "unlisted"}
    with pytest.raises(OSError, match="b.csv .wrong_md5.*c.csv .wrong_size.*d.csv .missing"):
        integrity.require_manifest(spark, str(folder), kept)


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    """No row holds a file that is larger than the bound, and sums stay those of the bytes."""
    assert integrity.ONE_ROW_BYTES <= 1 << 24
    folder = tmp_path / "some files"
    texts = {"small.csv": "a" * integrity.ONE_ROW_BYTES, "large %20.csv": "b" * (integrity.ONE_ROW_BYTES + 1)}
    for name, text in texts.items():
        write(folder / name, text)
    found = integrity.file_manifest(spark, str(folder))
    assert {r["file"]: r["md5"] for r in found.collect()} == {n: hashlib.md5(t.encode()).hexdigest() for n, t in texts.items()}
    assert {r["status"] for r in integrity.check_manifest(spark, str(folder), found).collect()} == {"ok"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and f"LessThanOrEqual(length,{integrity.ONE_ROW_BYTES})" in plan


def test_work_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or work_dir(spark).startswith(root.rstrip("/"))
    df = spark.range(5)
    kept = materialise(df, "numbers")
    assert values(kept) == values(df) and "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def own_tables(spark, path):
    made = {
        "nation": "select * from values (1, 'PERU'), (2, 'KENYA') t(n_nationkey, n_name)",
        "customer": "select * from values (10L, 'C10', 1, -5.0D, 'AUTO'), (11L, 'C11', 2, 70.0D, 'HOME'), (12L, 'C12', null, 1.0D, 'HOME') "
        "t(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)",
        "orders": "select o_orderkey, o_custkey, o_totalprice, timestamp(d) as o_orderdate, p as o_orderpriority from values "
        "(1L, 10L, 9.0D, '1999-03-04', 'LOW'), (2L, 10L, 8.0D, '1999-01-04', 'LOW'), (5L, 11L, 7.0D, null, null), (6L, 12L, 6.0D, '1999-01-04', 'LOW'), "
        "(7L, null, 6.0D, '1999-01-04', 'LOW') t(o_orderkey, o_custkey, o_totalprice, d, p)",
        "lineitem": "select * from values (1L, 0.02D, 10.0D, 'R'), (1L, 0.04D, 20.0D, 'N'), (5L, null, 30.0D, 'N') "
        "t(l_orderkey, l_discount, l_quantity, l_returnflag)",
        "documents": "select * from values (2L, 'why'), (3L, 'not') t(doc_id, text)",
    }
    for name, sql in made.items():
        spark.sql(sql).write.parquet(f"{path}/{name}.parquet")
    return path


def test_loan_view_of_few_rows(spark, tmp_path):
    found = loans.loan_view(spark, own_tables(spark, str(tmp_path)))
    shown = found.select("id", "revenue", "dti_n", "fico_n", "experience_c", "addr_state", "zip_code", "title", "desc", "Default")
    assert sorted(map(tuple, shown.collect())) == [
        (1, 0.0, 3.0, 465.0, 1, "PERU", "010xx", "C10", None, 1),
        (2, 0.0, None, None, 0, "PERU", "010xx", "C10", "why", 0),
        (5, 70.0, None, 630.0, 0, "KENYA", "011xx", None, None, 0),
    ]


def test_orders_are_dealt_by_their_key_with_no_more_than_they_become(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = loans.loan_view(spark, own_tables(spark, str(tmp_path)))
        plan = spark._jvm.PythonSQLUtils.explainString(view._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(o_orderkey", plan)
    assert len(dealt) == 1
    names = set(re.findall(r"(\w+)#", dealt[0]))
    assert "o_orderkey" in names and not names & {"n_name", "first_placed", "c_name", "c_acctbal", "o_custkey", "c_custkey"}
