"""Training, retraining, evaluation and gated promotion."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..contract import FeatureContract, load_contract
from ..operators.features import FEATURE_COLUMNS, get_xy
from ..operators.metrics import METRICS, classification_metrics, gate_passed, metrics_frame, quality_gate, reliability_curve
from ..operators.sampling import stratified_holdout
from ..operators.split import expanded_window
from ..session import materialise
from ..settings import Settings
from ..sources.exports import export_csv, export_json
from ..sources.store import load_or_build, load_split
from . import ledger
from .model import CATEGORICAL_ENCODING, ModelParams, ScoringModel, calibrate, fit_base

# Fixed value: share of the retraining window kept for calibration.
CALIBRATION_SHARE = 0.15


@dataclass(frozen=True)
class TrainingResult:
    model: ScoringModel
    metrics: dict[str, dict[str, float]]
    brier_uncalibrated: float
    gate: DataFrame
    passed: bool
    config_hash: str
    n_rows: dict[str, int]
    window: str
    version: int | None = None
    run_path: str | None = None

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        return metrics_frame(spark, self.metrics)


@dataclass(frozen=True)
class EvalResult:
    metrics: dict[str, float]
    gate: DataFrame
    passed: bool
    version: int | None = None
    stage: str | None = None


def _measure(scored: DataFrame, target: str, score: str = "score") -> dict[str, float]:
    row = classification_metrics(scored, score=score, target=target).first()
    return {m: row[m] for m in METRICS}


def _one_row(spark: SparkSession, metrics: Mapping[str, float]) -> DataFrame:
    return metrics_frame(spark, {"test": metrics})


def _fit_and_measure(
    base: DataFrame,
    held_out: DataFrame,
    test: DataFrame,
    *,
    params: ModelParams,
    settings: Settings,
    contract: FeatureContract,
    window: str,
    report_dir: str | None,
) -> TrainingResult:
    """Trees on ``base``, calibration on ``held_out``, metrics on ``held_out`` and ``test``."""
    spark, target = base.sparkSession, contract.target
    for frame in (base, held_out, test):
        get_xy(frame, contract)  # raises on a banned column
    model = calibrate(fit_base(base, params, target, contract.id_columns[0]), held_out, target)
    wanted = ["raw_score", "score", target]
    scored = {
        "valid": materialise(model.score(held_out).select(*wanted), "scored"),
        "test": materialise(model.score(test).select(*wanted), "scored"),
    }
    metrics = {name: _measure(rows, target) for name, rows in scored.items()}
    p = F.col("raw_score")
    before = scored["test"].agg(F.avg(F.pow(p - F.col(f"`{target}`"), F.lit(2)))).first()[0]
    gate = quality_gate(
        _one_row(spark, metrics["test"]),
        settings=settings,
        brier_uncalibrated=F.lit(before),
        brier_calibrated=F.lit(metrics["test"]["brier"]),
    )
    passed = gate_passed(gate).first()["passed"]
    n_rows = {"train": base.count(), "valid": int(metrics["valid"]["n"]), "test": int(metrics["test"]["n"])}
    result = TrainingResult(model, metrics, before, gate, passed, contract.config_hash, n_rows, window)
    if report_dir is not None:
        write_training_report(result, base, scored["test"], report_dir, target)
    return result


def write_training_report(result: TrainingResult, base: DataFrame, test_scored: DataFrame, path: str, target: str) -> None:
    """Metrics as JSON, reliability points and feature importance as CSV."""
    spark = base.sparkSession
    summary = metrics_frame(spark, result.metrics).withColumns(
        {"brier_uncalibrated": F.lit(result.brier_uncalibrated), "gate_passed": F.lit(result.passed)}
    )
    export_json(summary, f"{path}/metrics")
    curves = [
        reliability_curve(test_scored, score=s, target=target).withColumn("scores", F.lit(name))
        for name, s in (("uncalibrated", "raw_score"), ("calibrated", "score"))
    ]
    export_csv(curves[0].unionByName(curves[1]), f"{path}/reliability", order_by="bin", single_file=True)
    export_csv(result.model.importance(base), f"{path}/importance", order_by="mean_abs_shap", single_file=True)


def _log_and_register(
    spark: SparkSession, settings: Settings, contract: FeatureContract, result: TrainingResult, register: bool, run_path: str
) -> TrainingResult:
    result.model.save(f"{run_path}/model")
    if not register:
        return TrainingResult(**{**result.__dict__, "run_path": run_path})
    flat = {f"{split}_{k}": float(v) for split, m in result.metrics.items() for k, v in m.items() if v is not None}
    flat |= {"test_brier_uncalibrated": result.brier_uncalibrated, "gate_passed": float(result.passed)}
    params = {k: str(v) for k, v in asdict(result.model.params).items()}
    params |= {
        "n_features": str(len(FEATURE_COLUMNS)),
        "categorical_encoding": CATEGORICAL_ENCODING,
        "training_window": result.window,
        "feature_config_hash": result.config_hash,
        **{f"n_{k}": str(v) for k, v in result.n_rows.items()},
    }
    schema = ",".join(FEATURE_COLUMNS)

    def registered(version: int) -> ledger.Event:
        return ledger.Event(
            version,
            "registered",
            stage=ledger.STAGE_NONE,
            metrics=flat,
            params=params,
            tags={"feature_config_hash": contract.config_hash, "gate_passed": str(result.passed)},
            model_path=f"{run_path}/model",
            input_schema=schema,
        )

    version = ledger.register(spark, settings, registered)
    return TrainingResult(**{**result.__dict__, "version": version, "run_path": run_path})


def train(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    params: ModelParams | None = None,
    source: str | DataFrame | None = None,
    log: bool = True,
    register: bool = True,
) -> TrainingResult:
    """Trees on train, calibration on valid, gate on test; logged and registered unless told not to."""
    settings, params, contract = settings or Settings(), params or ModelParams(), load_contract()
    store = load_or_build(spark, settings, source)
    run_path = f"{settings.models_dir}/{uuid.uuid4().hex}" if log else None
    result = _fit_and_measure(
        store.split("train"), store.split("valid"), store.split("test"),
        params=params, settings=settings, contract=contract, window="train", report_dir=run_path,
    )
    return _log_and_register(spark, settings, contract, result, register, run_path) if log else result


def retrain(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    params: ModelParams | None = None,
    source: str | DataFrame | None = None,
    log: bool = True,
    register: bool = True,
    calibration_share: float = CALIBRATION_SHARE,
) -> TrainingResult:
    """Trees on train and valid together, calibrated on a stratified share kept out of them."""
    settings, params, contract = settings or Settings(), params or ModelParams(), load_contract()
    store = load_or_build(spark, settings, source)
    pool = stratified_holdout(
        expanded_window(store.frame).drop("split"),
        calibration_share,
        seed=params.seed,
        target=contract.target,
        id_column=contract.id_columns[0],
    )
    pool = materialise(pool, "training-pool")  # several jobs read either side
    run_path = f"{settings.models_dir}/{uuid.uuid4().hex}" if log else None
    result = _fit_and_measure(
        pool.where(~F.col("is_holdout")).drop("is_holdout"),
        pool.where("is_holdout").drop("is_holdout"),
        store.split("test"),
        params=params, settings=settings, contract=contract, window="train+valid", report_dir=run_path,
    )
    return _log_and_register(spark, settings, contract, result, register, run_path) if log else result


def evaluate_on_test(
    spark: SparkSession, model: ScoringModel, settings: Settings | None = None, *, latency_p95_ms: float | None = None
) -> EvalResult:
    """Score the test split and apply the gate."""
    settings, contract = settings or Settings(), load_contract()
    test = load_split(spark, "test", settings)
    get_xy(test, contract)
    scored = materialise(model.score(test).select("score", contract.target), "scored")
    metrics = _measure(scored, contract.target)
    latency = None if latency_p95_ms is None else F.lit(float(latency_p95_ms))
    gate = quality_gate(_one_row(spark, metrics), settings=settings, latency_p95_ms=latency)
    return EvalResult(metrics, gate, gate_passed(gate).first()["passed"])


def load_served(
    spark: SparkSession, settings: Settings | None = None, *, prefer_production: bool = True
) -> tuple[ScoringModel, int, str]:
    """The Production model, else the latest; an error when nothing is registered."""
    settings = settings or Settings()
    row = ledger.served_version(ledger.events(spark, settings), prefer_production).first()
    if row is None:
        raise RuntimeError(f"no registered versions of {settings.model_name!r}; train first")
    return ScoringModel.load(spark, row["model_path"]), row["version"], row["stage"]


def load_production(spark: SparkSession, settings: Settings | None = None) -> tuple[ScoringModel, int] | None:
    """The Production model only; None when there is none. Read failures are raised."""
    settings = settings or Settings()
    row = ledger.current_production(ledger.events(spark, settings)).first()
    return None if row is None else (ScoringModel.load(spark, row["model_path"]), row["version"])


def run_eval(spark: SparkSession, settings: Settings | None = None, *, prefer_production: bool = True) -> EvalResult:
    model, version, stage = load_served(spark, settings, prefer_production=prefer_production)
    found = evaluate_on_test(spark, model, settings)
    return EvalResult(found.metrics, found.gate, found.passed, version, stage)


@dataclass(frozen=True)
class PromotionResult:
    version: int
    promoted: bool
    stage: str
    gate: DataFrame
    passed: bool
    metrics: dict[str, float]
    archived: list[int] = field(default_factory=list)


def promote(
    spark: SparkSession,
    settings: Settings | None = None,
    *,
    version: int | None = None,
    archive_existing: bool = True,
    dry_run: bool = False,
    evaluate: Callable[[Row], EvalResult] | None = None,
) -> PromotionResult:
    """Evaluate, then move to Production if the gate passes.

    Nothing is written before the verdict, and a failed gate or a dry run writes nothing.
    ``evaluate`` turns the version's ledger row into a verdict; by default the model it names
    is measured on the test split.
    """
    settings = settings or Settings()
    state = ledger.stages(ledger.events(spark, settings)).collect()
    if not state:
        raise RuntimeError(f"no registered versions of {settings.model_name!r}; train first")
    version = max(r["version"] for r in state) if version is None else int(version)
    row = next((r for r in state if r["version"] == version), None)
    if row is None:
        raise RuntimeError(f"version {version} of {settings.model_name!r} is not registered")
    if evaluate is None:
        verdict = evaluate_on_test(spark, ScoringModel.load(spark, row["model_path"]), settings)
    else:
        verdict = evaluate(row)
    if not verdict.passed or dry_run:
        return PromotionResult(version, False, row["stage"], verdict.gate, verdict.passed, verdict.metrics)

    def decide(log: DataFrame) -> list[ledger.Event]:
        # What is in Production may have changed while the model was measured.
        now = ledger.stages(log).collect()
        return ledger.promotion_events(now, version, verdict.metrics["roc_auc"], archive_existing)

    change = ledger.commit(spark, settings, decide)
    archived = [e.version for e in change if e.stage == ledger.ARCHIVED]
    return PromotionResult(version, True, ledger.PRODUCTION, verdict.gate, True, verdict.metrics, archived)
