"""The closed loop: monitor, retrain when drift fires, gate, promote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..settings import Settings
from ..sources.store import build_feature_store, load_store
from ..streaming.drift import retrain_due
from . import ledger
from .model import ModelParams
from .monitoring import MonitoringResult, run_monitoring
from .training import PromotionResult, TrainingResult, promote, retrain, train


@dataclass(frozen=True)
class CycleResult:
    monitoring: MonitoringResult
    retrained: TrainingResult | None = None
    promotion: PromotionResult | None = None

    @property
    def action(self) -> str:
        return "none" if self.retrained is None else "retrained"


def retrain_and_promote(
    spark: SparkSession, settings: Settings, params: ModelParams | None = None
) -> tuple[TrainingResult, PromotionResult]:
    trained = retrain(spark, settings, params=params)
    return trained, promote(spark, settings, version=trained.version)


def run_cycle(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    params: ModelParams | None = None,
    inject: bool = True,
    sample_size: int | None = None,
    write_reports: bool = True,
    alerts_path: str | None = None,
    alerts_handled_until: object = None,
) -> CycleResult:
    """Monitor, and retrain and promote on drift: that of the batch, or an alert of a drift stream.

    ``alerts_path`` is the folder the stream works in; windows up to ``alerts_handled_until``
    count as answered.
    """
    settings = settings or Settings()
    found = run_monitoring(spark, settings, inject=inject, sample_size=sample_size, write_reports=write_reports)
    alerted = alerts_path is not None and retrain_due(spark, alerts_path, alerts_handled_until)
    if not (found.drift_detected or alerted):
        return CycleResult(found)
    return CycleResult(found, *retrain_and_promote(spark, settings, params))


def _served(spark: SparkSession, settings: Settings) -> int | None:
    row = ledger.current_production(ledger.events(spark, settings)).first()
    return None if row is None else row["version"]


def run_lifecycle(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    params: ModelParams | None = None,
    inject: bool = True,
    sample_size: int | None = None,
    write_reports: bool = True,
    alerts_path: str | None = None,
    alerts_handled_until: object = None,
) -> DataFrame:
    """Build the store and a first model where absent, run a cycle, and report what changed."""
    settings = settings or Settings()
    try:
        load_store(spark, settings)
    except FileNotFoundError:
        build_feature_store(spark, settings)
    if _served(spark, settings) is None:
        first = train(spark, settings, params=params)
        promote(spark, settings, version=first.version)
    before = _served(spark, settings)
    cycle = run_cycle(
        spark,
        settings,
        params=params,
        inject=inject,
        sample_size=sample_size,
        write_reports=write_reports,
        alerts_path=alerts_path,
        alerts_handled_until=alerts_handled_until,
    )
    after = _served(spark, settings)
    row = (
        before,
        after,
        cycle.monitoring.drift_detected,
        cycle.action,
        cycle.retrained.version if cycle.retrained else None,
        bool(cycle.promotion and cycle.promotion.promoted),
        before is not None and after is not None and before != after,
    )
    return spark.createDataFrame(
        [row],
        "version_before int, version_after int, drift_detected boolean, action string, retrained_version int, "
        "promoted boolean, served_version_changed boolean",
    )
