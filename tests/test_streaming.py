import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidemark import RAW_INPUT_COLUMNS, build_feature_matrix, fit_reference
from tidemark.catalog.queries import formula_score
from tidemark.functions import columns as fx
from tidemark.sources.loans import landed_path, table
from tidemark.streaming import drift as stream
from tidemark.streaming.scoring import start_rejects, start_scoring


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "value", "event_type")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def frozen(events):
    reference = events.where("ts < '2024-01-16'")
    return stream.FrozenReference.fit(reference, fit_reference(reference, ["value"]), ["event_type"])


def land(events, path, days):
    """One file per day, written in the given order, which is the order they are read in."""
    for i, day in enumerate(days):
        part = events.where(F.dayofmonth("ts") == day).coalesce(1)
        part.write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{path}/{i:02d}")


def source(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def run(spark, events, frozen, path, **options):
    query = stream.start_drift(source(spark, events, path / "in"), frozen, str(path / "out"), **options)
    query.awaitTermination()
    return stream.window_psi(spark, str(path / "out"), frozen)


def as_dict(psi):
    return {(str(r["window_start"]), r["feature"]): (round(r["psi"], 12), r["n_cur"]) for r in psi.collect()}


def batch(events, frozen):
    return as_dict(stream.windowed_psi(stream.windowed_cells(events, frozen, ts="ts", width="1 day"), frozen))


def test_in_order_stream_equals_batch(spark, events, frozen, tmp_path):
    days = range(16, 21)
    land(events, tmp_path / "in", days)
    later = events.where(F.dayofmonth("ts").between(16, 20))
    found = as_dict(run(spark, events, frozen, tmp_path))
    assert found == batch(later, frozen) and len(found) == 10


def test_rows_beyond_the_watermark_are_dropped_and_no_others(spark, events, frozen, tmp_path):
    land(events, tmp_path / "in", [20, 24, 18])
    found = as_dict(run(spark, events, frozen, tmp_path, watermark="1 hour"))
    kept = events.where(F.dayofmonth("ts").isin(20, 24))
    assert found == batch(kept, frozen)
    wide = tmp_path / "wide"
    land(events, wide / "in", [20, 24, 18])
    everything = events.where(F.dayofmonth("ts").isin(18, 20, 24))
    assert as_dict(run(spark, events, frozen, wide, watermark="10 days")) == batch(everything, frozen)


def test_restart_and_repeated_batches_change_nothing(spark, events, frozen, tmp_path):
    land(events, tmp_path / "in", [16])
    first = as_dict(run(spark, events, frozen, tmp_path))
    assert as_dict(run(spark, events, frozen, tmp_path)) == first
    part = events.where(F.dayofmonth("ts") == 17).coalesce(1)
    part.write.parquet(str(tmp_path / "in" / "01"))
    both = events.where(F.dayofmonth("ts").isin(16, 17))
    assert as_dict(run(spark, events, frozen, tmp_path)) == batch(both, frozen)


def test_alerts_name_the_drifted_windows(spark, events, frozen, tmp_path):
    moved = events.withColumn("value", F.when(F.dayofmonth("ts") == 18, F.col("value") + 500).otherwise(F.col("value")))
    land(moved, tmp_path / "in", [17, 18, 19])
    run(spark, events, frozen, tmp_path, threshold=2.0, key_features=["value"], watermark="1 hour")
    found = stream.alerts(spark, str(tmp_path / "out")).collect()
    assert [(str(r["window_start"])[:10], r["drifted_features"]) for r in found] == [("2024-01-18", ["value"])]
    assert stream.retrain_due(spark, str(tmp_path / "out"))
    assert not stream.retrain_due(spark, str(tmp_path / "out"), found[0]["window_start"])
    assert not stream.retrain_due(spark, str(tmp_path / "nowhere"))


def test_a_feature_missing_all_through_a_window_has_a_row_there(spark, events, frozen, tmp_path):
    hole = events.withColumn("value", F.when(F.dayofmonth("ts") != 18, F.col("value")))
    land(hole, tmp_path / "in", [17, 18])
    found = as_dict(run(spark, hole, frozen, tmp_path))
    assert found["2024-01-18 00:00:00", "value"] == (0.0, 0) and len(found) == 4


def closed(path):
    return sorted(p.name for p in (path / "out" / "windows").glob("window_id=*"))


def test_closed_windows_leave_the_state_and_are_written_once(spark, events, frozen, tmp_path):
    days = range(16, 24)
    land(events, tmp_path / "in", days)
    later = events.where(F.dayofmonth("ts").between(16, 23))
    assert as_dict(run(spark, events, frozen, tmp_path, watermark="1 hour")) == batch(later, frozen)
    left = stream.open_counts(spark, str(tmp_path / "out")).select(F.dayofmonth("window_start")).distinct().collect()
    assert [r[0] for r in left] == [23] and len(closed(tmp_path)) == 7
    files = [p for p in (tmp_path / "out" / "windows").rglob("*.parquet")]
    before = {p: p.stat().st_mtime_ns for p in files}
    assert len(files) == 7
    # Triggers that close nothing write nothing and touch no earlier window.
    events.where("dayofmonth(ts) = 23").coalesce(1).write.parquet(str(tmp_path / "in" / "99"))
    run(spark, events, frozen, tmp_path, watermark="1 hour")
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "windows").rglob("*.parquet")} == before


def test_a_batch_that_failed_before_its_commit_is_repeated(spark, events, frozen, tmp_path):
    land(events, tmp_path / "in", range(16, 20))
    found = as_dict(run(spark, events, frozen, tmp_path, watermark="1 hour", threshold=0.2))
    windows, commits = closed(tmp_path), tmp_path / "out" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for n in (last, last - 1):
        (commits / str(n)).unlink()
        (commits / f".{n}.crc").unlink(missing_ok=True)
    assert as_dict(run(spark, events, frozen, tmp_path, watermark="1 hour", threshold=0.2)) == found
    assert closed(tmp_path) == windows


def test_a_stream_without_rows_has_no_windows(spark, events, frozen, tmp_path):
    events.limit(0).write.parquet(str(tmp_path / "in"))
    assert run(spark, events, frozen, tmp_path).collect() == []
    assert stream.alerts(spark, str(tmp_path / "out")).collect() == []


def test_keys_default_to_those_of_the_batch_decision(events, frozen):
    assert frozen.key_features(None) == ("value", "event_type") and frozen.key_features(["value"]) == ("value",)
    with pytest.raises(KeyError):
        frozen.key_features(["fico_n"])
    named = events.withColumnRenamed("value", "fico_n")
    own = stream.FrozenReference.fit(named, fit_reference(named, ["fico_n"]), ["event_type"])
    assert own.key_features(None) == ("fico_n",)


def test_stream_scores_equal_batch_scores(spark, sf_dir, raw, tmp_path):
    def scorer(df):
        scored = formula_score(build_feature_matrix(df, keep=("id",)))
        return scored.select("id", "score", fx.risk_band(F.col("score")).alias("risk_band"))

    odd = raw.select("id", *RAW_INPUT_COLUMNS)
    arriving = spark.readStream.schema(raw.schema).parquet(landed_path(spark, sf_dir)).select(odd.columns)
    start_scoring(arriving, scorer, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    complete = "dti_n is not null and fico_n is not null"
    assert values(spark.read.parquet(str(tmp_path / "out"))) == values(scorer(odd.where(complete)))
    start_rejects(arriving, str(tmp_path / "rejected"), str(tmp_path / "ck2")).awaitTermination()
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert values(rejected.select("id")) == values(odd.where(f"not ({complete})"), "id")
    assert rejected.where("size(errors) = 0").isEmpty()
