import dataclasses
import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidemark import ModelParams, Settings, load_split, promote, run_lifecycle, train
from tidemark.__main__ import main
from tidemark.plans import ledger
from tidemark.plans.ledger import Event
from tidemark.plans.lifecycle import run_cycle
from tidemark.plans.training import load_production, load_served, run_eval
from tidemark.sources.store import build_feature_store, load_or_build

TINY = ModelParams(n_estimators=3, max_depth=3, learning_rate=0.3)


@pytest.fixture(scope="module")
def shared(tmp_path_factory, spark, raw):
    """A data folder with a store and one promoted model."""
    settings = Settings(root=str(tmp_path_factory.mktemp("life")), train_end="1998-12-31", valid_end="1999-12-31", roc_auc_min=0.55)
    raw.write.parquet(settings.raw_parquet)
    build_feature_store(spark, settings)
    first = train(spark, settings, params=TINY)
    assert promote(spark, settings, version=first.version).promoted
    return settings


def versions_of(spark, settings):
    return sorted(r["version"] for r in ledger.events(spark, settings).where("event = 'registered'").collect())


def test_a_writer_that_was_overtaken_decides_anew(spark, settings):
    """Two interleaved writers: the second commits between the first one's reading and writing."""
    seen = []

    def mine(version):
        if not seen:
            ledger.register(spark, settings, lambda v: Event(v, "registered", tags={"by": "other"}))
        seen.append(version)
        return Event(version, "registered", tags={"by": "me"})

    assert ledger.register(spark, settings, mine) == 2 and seen == [1, 2]
    assert versions_of(spark, settings) == [1, 2]


def test_writers_at_the_same_time_get_versions_of_their_own(spark, settings):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda i: ledger.register(spark, settings, lambda v: Event(v, "registered")), range(6)))
    assert sorted(found) == versions_of(spark, settings) == [1, 2, 3, 4, 5, 6]


def test_promotions_that_overlap_leave_one_version_in_production(spark, settings):
    ledger.append(spark, settings, [Event(v, "registered", stage="None") for v in (1, 2)])

    def second(log):
        state = ledger.stages(log).collect()
        if all(r["stage"] != "Production" for r in state):
            ledger.commit(spark, settings, lambda now: ledger.promotion_events(ledger.stages(now).collect(), 1, 0.7))
        return ledger.promotion_events(state, 2, 0.7)

    ledger.commit(spark, settings, second)
    assert {r["version"]: r["stage"] for r in ledger.stages(ledger.events(spark, settings)).collect()} == {1: "Archived", 2: "Production"}


def test_half_written_commits_are_passed_over(spark, settings, monkeypatch):
    monkeypatch.setattr(ledger, "_PATIENCE", 0.1)
    ledger.append(spark, settings, [Event(1, "registered")])
    path = f"{settings.ledger_dir}/commit-000000000002.json"
    with open(path, "w") as f:
        f.write('{"seq": 2000, "model_name": "%s", "version": 9, "event": "registered", "commit": 2, "size": 2}\n{"seq": 20' % settings.model_name)
    assert versions_of(spark, settings) == [1]
    assert ledger.register(spark, settings, lambda v: Event(v, "registered")) == 2
    assert versions_of(spark, settings) == [1, 2]


def test_ledger_folds_in_order(spark, settings):
    assert ledger.events(spark, settings).isEmpty()
    assert ledger.current_production(ledger.events(spark, settings)).first() is None
    for _ in range(11):
        ledger.register(spark, settings, lambda v: Event(v, "registered", stage="None", metrics={"test_roc_auc": v / 100}, tags={"a": "1"}))
    ledger.append(spark, settings, [Event(9, "stage", stage="Staging"), Event(9, "tagged", tags={"a": "2"}), Event(9, "stage", stage="Production")])
    log = ledger.events(spark, settings)
    assert [r["seq"] for r in log.orderBy("seq").collect()] == list(range(1, 15))
    assert ledger.latest_version(log).first()["version"] == 11  # a number, not text
    assert ledger.current_production(log).first()["version"] == 9
    assert ledger.served_version(log, prefer_production=False).first()["version"] == 11
    row = ledger.versions(log).where("version = 9").first()
    assert (row["stage"], row["tags"], row["metrics"]) == ("Production", {"a": "2"}, {"test_roc_auc": 0.09})
    other = dataclasses.replace(settings, model_name="another")
    assert ledger.events(spark, other).isEmpty()


def test_promotion_archives_and_commits_last(spark, settings):
    ledger.append(spark, settings, [Event(1, "registered", stage="None"), Event(2, "registered", stage="None"), Event(1, "stage", stage="Production")])
    state = ledger.stages(ledger.events(spark, settings)).collect()
    change = ledger.promotion_events(state, 2, 0.7)
    assert [(e.version, e.event, e.stage) for e in change] == [
        (2, "tagged", None), (2, "stage", "Staging"), (1, "stage", "Archived"), (2, "stage", "Production"),
    ]
    again = ledger.promotion_events(state, 1, 0.7)
    assert [(e.event, e.stage) for e in again] == [("tagged", None), ("stage", "Production")]
    kept = ledger.promotion_events(state, 2, 0.7, archive_existing=False)
    assert all(e.stage != "Archived" for e in kept)


def test_training_registers_with_lineage(spark, shared):
    log = ledger.events(spark, shared)
    row = ledger.versions(log).where("version = 1").first()
    assert row["tags"]["feature_config_hash"] == row["params"]["feature_config_hash"]
    assert row["params"]["training_window"] == "train" and row["params"]["n_features"] == "15"
    assert row["metrics"]["test_roc_auc"] > 0.5 and row["stage"] == "Production"
    info = ledger.model_info(spark, shared, 15).first()
    assert set(info["metrics"]) == set(ledger.INFO_METRICS) and info["version"] == 1
    run = row["model_path"].removesuffix("/model")
    assert spark.read.json(f"{run}/metrics").count() == 2
    assert spark.read.option("header", True).csv(f"{run}/importance").count() == 15
    assert spark.read.option("header", True).csv(f"{run}/reliability").count() > 4


def test_dry_run_and_failed_gate_change_nothing(spark, shared):
    before = ledger.events(spark, shared).count()
    dry = promote(spark, shared, dry_run=True)
    assert dry.passed and not dry.promoted
    strict = dataclasses.replace(shared, roc_auc_min=0.99)
    blocked = promote(spark, strict, version=1)
    assert not blocked.passed and not blocked.promoted and blocked.stage == "Production"
    assert ledger.events(spark, shared).count() == before
    assert load_production(spark, shared)[1] == 1
    assert run_eval(spark, shared).passed and not run_eval(spark, strict).passed


def test_repromoting_the_live_model_keeps_it_serving(spark, shared):
    again = promote(spark, shared, version=1)
    assert again.promoted and again.archived == []
    stages = [r["stage"] for r in ledger.events(spark, shared).where("version = 1 and stage is not null").orderBy("seq").collect()]
    assert stages.count("Staging") == 1


def test_loop_retrains_on_drift_and_only_then(spark, shared):
    calm = run_lifecycle(spark, shared, params=TINY, inject=False, write_reports=False).first()
    if not calm["drift_detected"]:
        assert calm["action"] == "none" and not calm["served_version_changed"]
    before = ledger.events(spark, shared).agg(F.max("version")).first()[0]
    fired = run_lifecycle(spark, shared, params=TINY).first()
    assert fired["drift_detected"] and fired["retrained_version"] == before + 1
    assert fired["promoted"] and fired["served_version_changed"]
    assert load_served(spark, shared)[1:] == (before + 1, "Production")
    params = ledger.versions(ledger.events(spark, shared)).where(F.col("version") == before + 1).first()["params"]
    rows = {s: load_split(spark, s, shared).count() for s in ("train", "valid")}
    assert params["training_window"] == "train+valid"
    assert int(params["n_train"]) + int(params["n_valid"]) == sum(rows.values())
    summary = spark.read.json(f"{shared.reports_dir}/drift_injected_summary").first()
    assert summary["drift_detected"] and summary["served_version"] is not None
    assert set(summary["feature_psi"].asDict()) >= {"fico_n", "zip_code"}


def test_an_alert_of_the_stream_retrains_without_batch_drift(spark, shared, tmp_path):
    row = "timestamp'2024-01-18' as window_start, 'fico_n' as feature, 1.5D as psi, 9L as n_cur, true as is_key, true as drifted"
    spark.sql(f"select {row}").write.parquet(str(tmp_path / "windows" / "window_id=1705536000000000"))
    quiet = dict(params=TINY, inject=False, write_reports=False, alerts_path=str(tmp_path))
    calm = dataclasses.replace(shared, psi_threshold=50.0)
    handled = run_cycle(spark, calm, alerts_handled_until=dt.datetime(2024, 1, 18), **quiet)
    assert handled.action == "none" and not handled.monitoring.drift_detected
    answered = run_cycle(spark, calm, **quiet)
    assert answered.action == "retrained" and not answered.monitoring.drift_detected


def test_nothing_registered_is_an_error(spark, settings):
    with pytest.raises(RuntimeError, match="train first"):
        load_served(spark, settings)
    assert load_production(spark, settings) is None


def test_store_loading(spark, settings, raw):
    with pytest.raises(FileNotFoundError):
        load_split(spark, "train", settings)
    with pytest.raises(ValueError, match="unknown split"):
        load_split(spark, "holdout", settings)
    built = load_or_build(spark, settings, source=raw)
    assert built.path is None
    with pytest.raises(FileNotFoundError):
        load_split(spark, "train", settings)
    raw.write.parquet(settings.raw_parquet)
    stored = load_or_build(spark, settings)
    assert stored.path == settings.features_dir
    assert values(stored.split("test"), "id") == values(load_split(spark, "test", settings), "id")
    assert "split" not in load_split(spark, "test", settings).columns


def test_verbs_and_exit_codes(spark, shared, capsys):
    assert main(["summary", "--source", shared.raw_parquet], spark, shared) == 0
    assert main(["features", "--no-write", "--source", shared.raw_parquet], spark, shared) == 0
    assert main(["eval"], spark, shared) == 0
    strict = dataclasses.replace(shared, roc_auc_min=0.99)
    assert main(["eval", "--latest"], spark, strict) == 1
    assert main(["promote"], spark, strict) == 1
    assert main(["promote", "--dry-run"], spark, strict) == 0
    assert main(["monitor", "--no-inject", "--no-reports", "--sample-size", "300"], spark, shared) == 0
    assert "roc_auc>=0.99" in capsys.readouterr().out


def test_a_commit_is_created_by_one_of_many_writers(spark, settings):
    for number in range(1, 41):
        start = Barrier(8)

        def create(i, number=number, start=start):
            start.wait()
            return ledger._create(spark, settings, number, [ledger.Event(i, "registered")])

        with ThreadPoolExecutor(8) as writers:
            assert sum(writers.map(create, range(8))) == 1
    assert ledger.events(spark, settings).count() == 40
