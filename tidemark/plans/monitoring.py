"""One monitoring cycle: incoming rows against the training distribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..contract import load_contract
from ..operators.drift import DriftReport, evaluate_drift
from ..operators.features import FEATURE_COLUMNS, apply_scenario
from ..operators.profile import column_profile, drift_report
from ..operators.sampling import exact_sample
from ..session import materialise
from ..settings import Settings
from ..sources.exports import export_json
from ..sources.store import load_store
from .training import load_production


@dataclass(frozen=True)
class MonitoringResult:
    report: DriftReport
    decision: Row
    served_version: int | None
    reports: dict[str, str]

    @property
    def drift_detected(self) -> bool:
        return self.decision["drift_detected"]


def _rows(frame: DataFrame, sample_size: int | None, seed: int, id_column: str) -> DataFrame:
    return frame if sample_size is None else exact_sample(frame, sample_size, seed=seed, id_column=id_column)


def run_monitoring(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    inject: bool = True,
    write_reports: bool = True,
    sample_size: int | None = None,
) -> MonitoringResult:
    """Train split against the test split, optionally stressed.

    All rows are used unless a sample size is given. Prediction drift compares with the valid
    split, which the model was not trained on, and is skipped without a Production model.
    """
    settings, contract = settings or Settings(), load_contract()
    store, key = load_store(spark, settings), contract.id_columns[0]
    size, seed = sample_size, settings.seed
    reference = _rows(store.split("train"), size, seed, key).select(*FEATURE_COLUMNS)
    incoming = _rows(store.split("test"), size, seed, key).select(*FEATURE_COLUMNS)
    current = apply_scenario(incoming) if inject else incoming

    served = load_production(spark, settings)
    scores: dict[str, DataFrame] = {}
    if served is not None:
        model = served[0]
        valid = _rows(store.split("valid"), size, seed, key).select(*FEATURE_COLUMNS)
        scores = {
            "ref_scores": materialise(model.score(valid).select("score"), "scores"),
            "cur_scores": materialise(model.score(current).select("score"), "scores"),
        }
    report = evaluate_drift(reference, current, threshold=settings.psi_threshold, **scores)
    version = served[1] if served else None
    decision = report.decision.withColumn("served_version", F.lit(version).cast("int"))
    decision = materialise(decision, "drift-decision")
    reports: dict[str, str] = {}
    if write_reports:
        prefix = f"{settings.reports_dir}/{'drift_injected' if inject else 'drift_baseline'}"
        reports = {"columns": f"{prefix}_columns", "profile": f"{prefix}_profile", "summary": f"{prefix}_summary"}
        export_json(drift_report(reference, current), reports["columns"])
        export_json(column_profile(current), reports["profile"])
        paths = F.create_map(*[F.lit(x) for pair in reports.items() for x in pair])
        export_json(decision.withColumn("reports", paths), reports["summary"])
    return MonitoringResult(report, decision.first(), version, reports)
