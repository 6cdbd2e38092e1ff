"""Spark-native credit-risk analytics: features, drift, metrics, scoring, lifecycle."""

from .contract import (
    FeatureContract,
    LeakageError,
    assert_lineage,
    assert_no_leakage,
    contract_hash,
    feature_columns_of,
    load_contract,
)
from .operators.cohorts import base_rate, cohort_rates, cohort_report, yearly_rates
from .operators.drift import (
    KEY_FEATURES,
    DriftReport,
    ReferenceBins,
    evaluate_drift,
    feature_psi,
    fit_reference,
    population_stability_index,
    prediction_psi,
    scenario_grid_psi,
)
from .operators.features import (
    CATEGORICAL_FEATURES,
    FEATURE_COLUMNS,
    NUMERIC_FEATURES,
    RAW_INPUT_COLUMNS,
    apply_scenario,
    build_feature_matrix,
    engineer_features,
    get_xy,
)
from .operators.metrics import classification_metrics, ks_statistic, quality_gate, reliability_curve
from .operators.profile import column_profile, drift_report, table_drift
from .operators.sampling import exact_sample, stratified_holdout, stratified_sample
from .operators.split import split_summary, time_split
from .plans.lifecycle import run_cycle, run_lifecycle
from .plans.model import ModelParams, ScoringModel
from .plans.monitoring import run_monitoring
from .plans.scoring import score_batch, validate_applications
from .plans.training import evaluate_on_test, load_served, promote, retrain, run_eval, train
from .settings import Settings
from .sources.paths import resolve_source
from .sources.readers import land_raw, read_loans, validate_source
from .sources.store import FeatureStore, build_feature_store, load_split

__version__ = "0.1.0"

__all__ = [name for name in dir() if not name.startswith("_")]
