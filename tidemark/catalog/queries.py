"""Queries over the provided tables, one per operator family.

Every query reads the loan view landed from the tables (or the tables themselves) in full.
Floating results are rounded so that summation order does not show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import find_leaks
from ..functions import columns as fx
from ..operators import attribution, boosting, cohorts, drift, encoding, metrics, profile, sampling, split
from ..operators.features import (
    CATEGORICAL_FEATURES,
    RAW_INPUT_COLUMNS,
    apply_scenario,
    build_feature_matrix,
    engineer_features,
)
from ..operators.isotonic import fit_isotonic
from ..operators.quantiles import exact_quantiles
from ..plans import ledger
from ..plans.lifecycle import run_lifecycle
from ..plans.model import ModelParams, ScoringModel, calibrate, fit_base
from ..plans.scoring import score_batch, with_errors
from ..plans.training import EvalResult, promote
from ..session import materialise, work_dir
from ..settings import Settings
from ..sources import exports, integrity, loans, readers
from ..sources.loans import VIEW_SETTINGS, loan_features, loan_reference, raw_loans, table
from ..streaming import drift as stream_drift
from ..streaming import scoring as stream_scoring

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

# A stand-in score with real signal, and rivals of it with less.
SCORE_WEIGHTS = (-1.2, 0.5, -0.002)
CANDIDATES = ((1, -1.2, 0.5, -0.002), (2, 0.0, 0.0, -0.01), (3, -1.0, 0.4, 0.0), (4, 0.3, 0.01, 0.02))
SEVERITIES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
# Events up to this moment are the reference of the streaming drift query.
STREAM_REFERENCE_END = "2024-01-16"
# Planted drift of the alert query: what is added to values, and the PSI that alerts.
STREAM_SHIFT = 50.0
STREAM_THRESHOLD = 0.2


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_registry)


def _r(name: str | Column, digits: int = 9) -> Column:
    return F.round(name, digits)


def _split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return loan_features(spark, sf_dir).where(F.col("split") == name)


def _logistic(a: float, b: float, c: float) -> Column:
    # Orders without lines have neither; they count as new in the job and of middling credit.
    z = a + b * F.coalesce("emp_length_years", F.lit(0.0)) + c * (F.coalesce("fico_n", F.lit(600.0)) - 600)
    return F.round(1 / (1 + F.exp(-z)), 6)


def formula_score(df: DataFrame) -> DataFrame:
    """Rows scored by a fixed logistic of two features."""
    return df.withColumn("score", _logistic(*SCORE_WEIGHTS))


def _scored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return formula_score(_split(spark, sf_dir, name)).select("id", "score", "Default")


# --- sources ---------------------------------------------------------------------------


@query
def source_validation(spark, sf_dir):
    found = readers.validate_source(raw_loans(spark, sf_dir))
    return found.select("n_rows", "bad_targets", F.size("missing_columns").cast("bigint").alias("n_missing"), "valid")


@query
def csv_round_trip(spark, sf_dir):
    """Ordered CSV export, landing with parsed dates, and a summary of what came back."""
    root = f"{work_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    exports.export_csv(raw_loans(spark, sf_dir).drop("issue_date"), f"{root}/loans.csv")
    settings = Settings(root=root)
    landed = spark.read.parquet(readers.land_raw(spark, settings, csv_path=f"{root}/loans.csv"))
    return landed.groupBy(F.col("issue_date").cast("string").alias("issue_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("Default").cast("bigint")).alias("n_default"),
        _r(F.sum("loan_amnt"), 2).alias("loan_amnt"),
        F.coalesce(F.sum(F.length("desc").cast("bigint")), F.lit(0)).alias("desc_chars"),
        F.count("title").alias("titles"),
        F.countDistinct("id").alias("ids"),
    )


@query
def manifest_check(spark, sf_dir):
    """The table files against a manifest that is wrong in four known places."""
    manifest = integrity.file_manifest(spark, sf_dir, "*.parquet").where("file <> 'part.parquet'")
    wrong = manifest.select(
        "file",
        (F.col("size_bytes") + F.when(F.col("file") == "region.parquet", 1).otherwise(0)).alias("size_bytes"),
        F.when(F.col("file") == "nation.parquet", F.reverse("md5")).otherwise(F.col("md5")).alias("md5"),
    )
    absent = manifest.where("file = 'orders.parquet'").withColumn("file", F.lit("absent.parquet"))
    return integrity.check_manifest(spark, sf_dir, wrong.unionByName(absent), "*.parquet")


# --- cohorts ---------------------------------------------------------------------------


@query
def base_rate(spark, sf_dir):
    return cohorts.base_rate(raw_loans(spark, sf_dir)).withColumn("base_rate", _r("base_rate"))


def _cohort(df: DataFrame) -> DataFrame:
    return df.withColumn("default_rate", _r("default_rate"))


@query
def cohort_by_purpose(spark, sf_dir):
    return _cohort(cohorts.cohort_rates(raw_loans(spark, sf_dir), "purpose"))


@query
def cohort_by_home(spark, sf_dir):
    return _cohort(cohorts.cohort_rates(raw_loans(spark, sf_dir), "home_ownership_n"))


@query
def cohort_min_count(spark, sf_dir):
    return _cohort(cohorts.cohort_rates(raw_loans(spark, sf_dir), "emp_length", min_count=500))


@query
def cohort_top12(spark, sf_dir):
    return _cohort(cohorts.cohort_rates(raw_loans(spark, sf_dir), "zip_code", top=12))


@query
def yearly_cohort(spark, sf_dir):
    return _cohort(cohorts.yearly_rates(raw_loans(spark, sf_dir)))


@query
def cohort_report(spark, sf_dir):
    return _cohort(cohorts.cohort_report(raw_loans(spark, sf_dir)))


@query
def value_shares(spark, sf_dir):
    return cohorts.value_shares(raw_loans(spark, sf_dir), "title").withColumn("share", _r("share", 12))


@query
def distinct_values(spark, sf_dir):
    return cohorts.distinct_values(
        raw_loans(spark, sf_dir), ["id", "issue_d", "purpose", "addr_state", "zip_code", "title", "loan_amnt"]
    )


# --- features --------------------------------------------------------------------------


@query
def issue_date_parse(spark, sf_dir):
    raw = raw_loans(spark, sf_dir).select("id", "issue_d", "issue_date")
    derived = fx.issue_date(raw.drop("issue_date"), typed="issue_date", raw="issue_d")
    typed = fx.issue_date(raw, typed="issue_date", raw="issue_d")
    return raw.select(
        "id", derived.cast("string").alias("derived"), typed.cast("string").alias("typed"), F.year(derived).alias("yr")
    )


@query
def emp_length_parse(spark, sf_dir):
    return (
        raw_loans(spark, sf_dir)
        .groupBy("emp_length", fx.emp_length_years(F.col("emp_length")).alias("years"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def text_flags(spark, sf_dir):
    return raw_loans(spark, sf_dir).select(
        "id",
        fx.has_text(F.col("desc")).cast("int").alias("has_desc"),
        fx.text_length(F.col("desc")).alias("desc_len"),
        fx.has_text(F.col("title")).cast("int").alias("has_title"),
        fx.text_length(F.col("title")).alias("title_len"),
    )


@query
def safe_ratio(spark, sf_dir):
    return raw_loans(spark, sf_dir).select(
        "id", _r(fx.safe_ratio(F.col("loan_amnt"), F.col("revenue")), 6).alias("loan_to_income")
    )


@query
def feature_matrix(spark, sf_dir):
    rounded = {"dti_n": 8, "fico_n": 8, "loan_to_income": 6}
    frame = engineer_features(raw_loans(spark, sf_dir))
    return frame.withColumns({c: _r(c, d) for c, d in rounded.items()}).withColumn(
        "issue_date", F.col("issue_date").cast("string")
    )


@query
def leak_independence(spark, sf_dir):
    """Feature rows that change when outcome columns are added to the raw table: none may."""
    raw = raw_loans(spark, sf_dir)
    poisoned = raw.withColumns(
        {
            "int_rate": F.lit(13.5),
            "grade": F.lit("C"),
            "loan_status": F.lit("Charged Off"),
            "recoveries": F.col("loan_amnt") * F.col("Default"),
        }
    )
    clean, dirty = (build_feature_matrix(d, keep=("id",)) for d in (raw, poisoned))
    changed = split.rows_only_in_one(clean, dirty).agg(F.count(F.lit(1))).scalar()
    return clean.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_changed", changed)



@query
def leak_lineage(spark, sf_dir):
    """Feature tables that an outcome column reaches in four ways, and one that it does not.

    Each is followed back to its sources and, to see what the leak does, compared with the clean one.
    """
    outcome = raw_loans(spark, sf_dir).withColumn("recoveries", F.round(F.col("loan_amnt") * F.col("Default") / 2, 2))
    leaky = materialise(outcome, "leaky", compression="zstd")  # texts included, as the landed view
    side = leaky.select(F.col("id").alias("key"), F.col("recoveries").alias("r"))
    ways = {
        "clean": leaky,
        "renamed": leaky.drop("dti_n").withColumnRenamed("recoveries", "dti_n"),
        "joined": leaky.drop("dti_n").join(side, F.col("id") == F.col("key")).withColumnRenamed("r", "dti_n"),
        "filtered": leaky.where("recoveries > 0"),
    }
    clean = build_feature_matrix(leaky, keep=("id",))
    rows = []
    for way, raw in ways.items():
        features = build_feature_matrix(raw, keep=("id",))
        leaks = find_leaks(features)
        changed = split.rows_only_in_one(clean, features).select("id").distinct()
        said = [", ".join(f"{c} <- {s}" for c, s in leaks.computed), ", ".join(leaks.selecting)]
        told = [F.lit(way).alias("way"), F.lit(said[0]).alias("computed_from"), F.lit(said[1]).alias("selected_by")]
        rows.append(changed.agg(F.count(F.lit(1)).alias("n_changed")).select(*told, "n_changed"))
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query
def scenario_features(spark, sf_dir):
    stressed = apply_scenario(_split(spark, sf_dir, "test"))
    return stressed.select(
        "id", _r("fico_n", 6).alias("fico_n"), _r("dti_n", 6).alias("dti_n"), _r("revenue", 4).alias("revenue"),
        "loan_amnt", _r("loan_to_income", 5).alias("loan_to_income"),
    )


# --- splits and samples ----------------------------------------------------------------


@query
def time_split_summary(spark, sf_dir):
    found = split.split_summary(loan_features(spark, sf_dir))
    return found.select(
        "split", "rows", F.col("date_min").cast("string").alias("date_min"),
        F.col("date_max").cast("string").alias("date_max"), _r("default_rate").alias("default_rate"),
    )


@query
def split_integrity(spark, sf_dir):
    return split.split_integrity(loan_features(spark, sf_dir), VIEW_SETTINGS)


@query
def stratified_sample(spark, sf_dir):
    sample = sampling.stratified_sample(raw_loans(spark, sf_dir), 20)
    return sample.select("id", "issue_d", "loan_amnt", "emp_length", "Default").orderBy("id")


@query
def exact_sample(spark, sf_dir):
    return sampling.exact_sample(_split(spark, sf_dir, "train"), 500).select("id", "loan_amnt", "purpose")


@query
def expanded_window_holdout(spark, sf_dir):
    pool = sampling.stratified_holdout(split.expanded_window(loan_features(spark, sf_dir)))
    return pool.select("id", "Default", "is_holdout")


# --- drift -----------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, drift.ReferenceBins]:
    return _split(spark, sf_dir, "train"), _split(spark, sf_dir, "test"), loan_reference(spark, sf_dir)


@query
def psi_numeric(spark, sf_dir):
    ref, cur, bins = _sides(spark, sf_dir)
    return drift.feature_psi(ref, cur, bins=bins, categorical=()).select("feature", _r("psi").alias("psi"))


@query
def psi_categorical(spark, sf_dir):
    ref, cur, _ = _sides(spark, sf_dir)
    return drift.feature_psi(ref, cur, numeric=()).select("feature", _r("psi").alias("psi"))


@query
def feature_psi(spark, sf_dir):
    ref, cur, bins = _sides(spark, sf_dir)
    return drift.feature_psi(ref, apply_scenario(cur), bins=bins).select("feature", "kind", _r("psi").alias("psi"))


@query
def prediction_psi(spark, sf_dir):
    found = drift.prediction_psi(_scored(spark, sf_dir, "valid"), _scored(spark, sf_dir, "test"))
    return found.select(_r("psi").alias("psi"))


@query
def drift_decision(spark, sf_dir):
    ref, cur, bins = _sides(spark, sf_dir)
    stressed = apply_scenario(cur)
    found = drift.evaluate_drift(
        ref,
        stressed,
        ref_scores=_scored(spark, sf_dir, "valid"),
        cur_scores=formula_score(stressed).select("score"),
        bins=bins,
    )
    return found.decision.select(
        F.array_join("drifted_features", ",").alias("drifted_features"), "key_drift",
        _r("prediction_psi").alias("prediction_psi"), "prediction_drift", "drift_detected", "n_reference", "n_current",
    )


@query
def drift_decision_baseline(spark, sf_dir):
    """The reference against itself: nothing may fire."""
    ref, _, bins = _sides(spark, sf_dir)
    found = drift.evaluate_drift(ref, ref, bins=bins)
    return found.decision.select(
        F.array_join("drifted_features", ",").alias("drifted_features"), "key_drift", "drift_detected", "n_reference"
    )


@query
def scenario_grid_psi(spark, sf_dir):
    ref, _, bins = _sides(spark, sf_dir)
    return drift.scenario_grid_psi(ref, SEVERITIES, bins).withColumn("psi", _r("psi"))


@query
def drift_report(spark, sf_dir):
    ref, cur, _ = _sides(spark, sf_dir)
    found = profile.drift_report(ref, apply_scenario(cur))
    return found.withColumns({c: _r(c) for c in ("distance", "ks", "ref_missing", "cur_missing")})


@query
def table_drift(spark, sf_dir):
    ref, cur, _ = _sides(spark, sf_dir)
    return profile.table_drift(profile.drift_report(ref, apply_scenario(cur))).withColumn("drift_share", _r("drift_share"))


@query
def column_profile(spark, sf_dir):
    found = profile.column_profile(_split(spark, sf_dir, "train"))
    return found.select(
        "feature", "rows", "n", "missing", "distinct", "top_count", "top_level", _r("top_number", 4).alias("top_number"),
        *[_r(c, 4).alias(c) for c in ("min", "max", "mean", "std", "q25", "q50", "q75")],
    )


@query
def deciles(spark, sf_dir):
    names = ["fico_n", "dti_n", "revenue", "loan_amnt"]
    found = exact_quantiles(_split(spark, sf_dir, "train"), names, [i / 10 for i in range(11)])
    rows = [(c, i, v) for c in names for i, v in enumerate(found[c])]
    return spark.createDataFrame(rows, "feature string, decile int, value double").withColumn("value", _r("value", 6))


@query
def histogram(spark, sf_dir):
    ref, cur, bins = _sides(spark, sf_dir)
    return drift.count_cells({"ref": ref, "cur": cur}, bins, ()).select("feature", "bin", "ref", "cur")


# --- metrics ---------------------------------------------------------------------------


def _metric(column: str) -> Query:
    def run(spark, sf_dir):
        found = metrics.classification_metrics(_scored(spark, sf_dir, "test"))
        return found.select(_r(column).alias(column))

    return run


_registry["roc_auc"] = _metric("roc_auc")
_registry["average_precision"] = _metric("pr_auc")
_registry["ks"] = _metric("ks")
_registry["brier"] = _metric("brier")


@query
def metrics_by_split(spark, sf_dir):
    scored = formula_score(loan_features(spark, sf_dir)).select("split", "score", "Default")
    found = metrics.classification_metrics(scored, by=["split"])
    return found.select("split", *[_r(m).alias(m) for m in metrics.METRICS if m != "n"], "n")


@query
def reliability_curve(spark, sf_dir):
    found = metrics.reliability_curve(_scored(spark, sf_dir, "test"))
    return found.withColumns({c: _r(c) for c in ("mean_predicted", "observed_rate")})


@query
def latency_p95(spark, sf_dir):
    """Exact 95th percentile of a measured value, tested against the latency limit."""
    p95 = exact_quantiles(table(spark, sf_dir, "events"), ["value"], [0.95])["value"][0]
    limit = Settings().latency_p95_ms
    return spark.createDataFrame([(round(p95, 9), p95 < limit)], "p95 double, passed boolean")


@query
def quality_gate(spark, sf_dir):
    scored = _scored(spark, sf_dir, "test")
    found = metrics.classification_metrics(scored)
    squared = scored.agg(F.avg(F.pow(F.col("score") * F.col("score") - F.col("Default"), F.lit(2)))).scalar()
    p95 = exact_quantiles(table(spark, sf_dir, "events"), ["value"], [0.95])["value"][0]
    with_reports = found.withColumn("before", squared)
    return metrics.quality_gate(
        with_reports, brier_uncalibrated=F.col("before"), brier_calibrated=F.col("brier"), latency_p95_ms=F.lit(p95)
    )


# --- model -----------------------------------------------------------------------------


@query
def target_encode_oof(spark, sf_dir):
    train = _split(spark, sf_dir, "train")
    coded = encoding.fit_target_encoding(train).transform_train(train)
    return coded.select("id", *[_r(f"{c}{encoding.SUFFIX}").alias(f"{c}{encoding.SUFFIX}") for c in CATEGORICAL_FEATURES])


@query
def target_encode_new(spark, sf_dir):
    coded = encoding.fit_target_encoding(_split(spark, sf_dir, "train")).encoding.transform(_split(spark, sf_dir, "test"))
    return coded.select("id", *[_r(f"{c}{encoding.SUFFIX}").alias(f"{c}{encoding.SUFFIX}") for c in CATEGORICAL_FEATURES])


def demo_model(spark: SparkSession, sf_dir: str) -> ScoringModel:
    """The model at its full size, trained once per session and saved."""
    def write(path: str) -> None:
        rows = loan_features(spark, sf_dir)
        train, valid = (rows.where(F.col("split") == s) for s in ("train", "valid"))
        calibrate(fit_base(train, ModelParams()), valid).save(path)

    return ScoringModel.load(spark, loans.land_once(spark, sf_dir, "model", write))


# Cuts of a tree small enough to be grown in SQL.
ROUND_CUTS = {"fico_n": (540, 560, 580, 600, 620, 640), "dti_n": (2, 4, 6, 8, 12, 16, 24), "emp_length_years": (1, 2, 4, 6)}
ROUND_PARAMS = boosting.TreeParams(trees=1, depth=2, learning_rate=0.3, min_child_weight=5.0, l2=1.0)


@query
def boosting_round(spark, sf_dir):
    """One round of boosting on the train split: a tree of two levels from even odds."""
    rows = _split(spark, sf_dir, "train")
    inputs = list(ROUND_CUTS)
    found = boosting.boost(
        rows, inputs, ROUND_PARAMS, label="Default", id_column="id", cuts=list(ROUND_CUTS.values()), base=0.0, task_rows=20_000
    )
    nodes = found.table(spark).where("tree = 0")
    names = F.element_at(F.array(*map(F.lit, inputs)), F.col("feature") + 1)
    inner = F.col("feature") >= 0
    return nodes.select(
        "node",
        F.when(inner, names).alias("feature"),
        F.when(inner, F.col("threshold")).alias("threshold"),
        F.when(inner, F.col("missing_left")).alias("missing_left"),
        _r(F.when(~inner, F.col("value"))).alias("value"),
        _r("cover", 6).alias("cover"),
    )


@query
def gbt_calibrated_scores(spark, sf_dir):
    return demo_model(spark, sf_dir).score(_split(spark, sf_dir, "test")).select("id", "margin", "raw_score", "score")


@query
def gbt_metrics(spark, sf_dir):
    rows = _split(spark, sf_dir, "test")
    return metrics.classification_metrics(demo_model(spark, sf_dir).score(rows).select("score", "Default"))


@query
def score_applications(spark, sf_dir):
    """Every application: the accepted ones scored, the rejected ones with their errors."""
    checked = with_errors(raw_loans(spark, sf_dir).select("id", *RAW_INPUT_COLUMNS))
    accepted = checked.where(F.size("errors") == 0).drop("errors")
    scored = score_batch(accepted, demo_model(spark, sf_dir), version=1, stage=ledger.PRODUCTION)
    return checked.select("id", F.array_join("errors", "; ").alias("errors")).join(scored, "id", "left")


@query
def global_attribution(spark, sf_dir):
    return demo_model(spark, sf_dir).importance(_split(spark, sf_dir, "train"))


def _node(feature: int, threshold: float, left: int, right: int) -> dict:
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "prediction": 0.0}


def _leaf(value: float) -> dict:
    return {"feature": -1, "threshold": None, "left": -1, "right": -1, "prediction": value}


# A forest small enough to be explained by hand.
FOREST_INPUTS = ("fico_n", "loan_amnt", "dti_n")
FOREST = (
    {0: _node(0, 560.0, 1, 2), 1: _node(1, 150000.0, 3, 4), 2: _leaf(-0.4), 3: _leaf(0.7), 4: _leaf(0.1)},
    {0: _node(2, 5.0, 1, 2), 1: _leaf(0.3), 2: _node(0, 600.0, 3, 4), 3: _leaf(-0.2), 4: _leaf(-0.9)},
)


def _forest_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = _split(spark, sf_dir, name)
    return rows.withColumns({"fico_n": F.coalesce("fico_n", F.lit(600.0)), "dti_n": F.coalesce("dti_n", F.lit(5.0))})


def fixed_forest(train: DataFrame) -> attribution.TreeTables:
    """The forest with the covers that its nodes have in ``train``."""
    reached: dict[tuple[int, int], Column] = {}
    for number, tree in enumerate(FOREST):
        stack = [(0, F.lit(True))]
        while stack:
            at, condition = stack.pop()
            reached[number, at] = condition
            node = tree[at]
            if node["left"] >= 0:
                left = F.col(FOREST_INPUTS[node["feature"]]) <= node["threshold"]
                stack += [(node["left"], condition & left), (node["right"], condition & ~left)]
    counts = train.agg(*[F.count_if(c).alias(f"n{t}_{i}") for (t, i), c in reached.items()]).first()
    trees = [{i: node | {"cover": counts[f"n{t}_{i}"]} for i, node in tree.items()} for t, tree in enumerate(FOREST)]
    return attribution.tables_of(trees, [1.0] * len(trees))


FOREST_GROUPS = [(c, (c,)) for c in FOREST_INPUTS]


@query
def forest_attribution(spark, sf_dir):
    """Contributions of the fixed forest: of every row the two largest, with their direction."""
    tables, rows = fixed_forest(_forest_rows(spark, sf_dir, "train")), _forest_rows(spark, sf_dir, "test")
    explained = attribution.attribute_rows(rows, tables, FOREST_INPUTS, FOREST_GROUPS, keep=["id"])
    shown = attribution.directed(attribution.top_contributions(explained, 2), 6)
    rows = shown.select("id", _r("base_value").alias("base_value"), F.posexplode("top_contributions").alias("place", "c"))
    return rows.select("id", "base_value", "place", "c.feature", "c.shap", "c.pushes")


@query
def forest_global(spark, sf_dir):
    tables, rows = fixed_forest(_forest_rows(spark, sf_dir, "train")), _forest_rows(spark, sf_dir, "test")
    found = attribution.mean_contributions(rows, tables, FOREST_INPUTS, FOREST_GROUPS)
    return found.select("feature", _r("mean_abs_shap", 6).alias("mean_abs_shap"))


@query
def isotonic_scores(spark, sf_dir):
    """The stand-in score, rounded, calibrated on the valid split and applied to it."""
    rows = formula_score(_split(spark, sf_dir, "valid"))
    points = rows.select(F.round("score", 2).alias("raw_score"), F.col("Default").cast("double").alias("y"))
    curve = fit_isotonic(points).transform(points.select("raw_score").distinct())
    return curve.select("raw_score", _r("calibrated", 6).alias("calibrated"))


@query
def row_attribution(spark, sf_dir):
    explained = demo_model(spark, sf_dir).explain(_split(spark, sf_dir, "test"), keep=["id"])
    return attribution.directed(attribution.top_contributions(explained))


@query
def validate_applications(spark, sf_dir):
    """Applications whose numbers arrive negated for every 97th id, to have something to reject."""
    raw = raw_loans(spark, sf_dir).select("id", *RAW_INPUT_COLUMNS)
    odd = raw.withColumn("loan_amnt", F.when(F.col("id") % 97 == 0, -F.col("loan_amnt")).otherwise(F.col("loan_amnt")))
    return with_errors(odd).select(
        "id", F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("accepted")
    )


@query
def risk_bands(spark, sf_dir):
    scored = formula_score(loan_features(spark, sf_dir)).withColumn("score", F.col("score") * F.col("score"))
    return scored.groupBy(fx.risk_band(F.col("score")).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("score")).alias("mean_score"), _r(F.avg("Default")).alias("default_rate")
    )


@query
def ledger_current(spark, sf_dir):
    """Rival scores as versions: measured in one job, gated, promoted in turn, folded to what is served."""
    settings = Settings(root=f"{work_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}")
    rows = _split(spark, sf_dir, "test")
    rivals = F.inline(F.array(*[F.struct(F.lit(v).alias("version"), _logistic(a, b, c).alias("score")) for v, a, b, c in CANDIDATES]))
    measured = metrics.classification_metrics(rows.select("Default", rivals), by=["version"])
    for row in measured.orderBy("version").collect():  # one row per version
        found = {m: row[m] for m in metrics.METRICS}
        event = {"metrics": {"test_roc_auc": found["roc_auc"]}, "stage": ledger.STAGE_NONE}
        version = ledger.register(spark, settings, lambda v, e=event: ledger.Event(v, "registered", **e))
        gate = metrics.quality_gate(metrics.metrics_frame(spark, {"test": found}), settings=settings)
        verdict = EvalResult(found, gate, metrics.gate_passed(gate).first()["passed"])
        promote(spark, settings, version=version, evaluate=lambda _, v=verdict: v)
    log = ledger.events(spark, settings)
    served = ledger.served_version(log).select(F.col("version").alias("served"))
    return (
        ledger.versions(log)
        .join(served, F.col("version") == F.col("served"), "left")
        .select(
            "version", "stage", _r(F.col("metrics")["test_roc_auc"]).alias("test_roc_auc"),
            F.coalesce(F.col("tags")["promoted"], F.lit("false")).alias("promoted"), F.col("served").isNotNull().alias("served"),
        )
    )


@query
def lifecycle_run(spark, sf_dir):
    """Build the store, train, promote, see injected drift, retrain on the wider window, promote again."""
    root = f"{work_dir(spark)}/lifecycle-{uuid.uuid4().hex[:12]}"
    settings = Settings(root=root, train_end=VIEW_SETTINGS.train_end, valid_end=VIEW_SETTINGS.valid_end)
    raw_loans(spark, sf_dir).write.parquet(settings.raw_parquet)
    return run_lifecycle(spark, settings)


# --- streams ---------------------------------------------------------------------------


def _stream(spark: SparkSession, like: DataFrame, path: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(path)


@query
def stream_psi(spark, sf_dir):
    """PSI of later events per day against the first half of the month, kept by a stream."""
    events = table(spark, sf_dir, "events").select("ts", "value", "event_type")
    end = F.lit(STREAM_REFERENCE_END).cast("timestamp_ntz")
    reference = events.where(F.col("ts") < end)
    bins = drift.fit_reference(reference, ["value"])
    frozen = stream_drift.FrozenReference.fit(reference, bins, ["event_type"])
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    arriving = _stream(spark, table(spark, sf_dir, "events"), sf_dir, "events.parquet").where(F.col("ts") >= end)
    running = stream_drift.start_drift(arriving.select("ts", "value", "event_type"), frozen, path)
    running.awaitTermination()
    found = stream_drift.window_psi(spark, path, frozen)
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", _r("psi").alias("psi"), F.col("n_cur").alias("n")
    )


@query
def stream_scores(spark, sf_dir):
    """Applications scored as a stream with the stand-in score."""
    raw = raw_loans(spark, sf_dir)
    path = f"{work_dir(spark)}/scores-{uuid.uuid4().hex[:12]}"

    def scorer(df: DataFrame) -> DataFrame:
        scored = formula_score(build_feature_matrix(df, keep=("id",)))
        return scored.select("id", "score", fx.risk_band(F.col("score")).alias("risk_band"))

    arriving = _stream(spark, raw, loans.landed_path(spark, sf_dir)).select("id", *RAW_INPUT_COLUMNS)
    stream_scoring.start_scoring(arriving, scorer, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("id bigint, score double, risk_band string").parquet(f"{path}/out")


@query
def stream_rejects(spark, sf_dir):
    """Applications that the stream turns away, and why: the rest of those scored."""
    raw = raw_loans(spark, sf_dir)
    path = f"{work_dir(spark)}/rejects-{uuid.uuid4().hex[:12]}"
    arriving = _stream(spark, raw, loans.landed_path(spark, sf_dir)).select("id", *RAW_INPUT_COLUMNS)
    stream_scoring.start_rejects(arriving, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = spark.read.schema("id bigint, errors array<string>").parquet(f"{path}/out")
    return found.select("id", F.array_join("errors", "; ").alias("errors"))


@query
def stream_alerts(spark, sf_dir):
    """Days that the watermark has closed on which the values or types of events drifted."""
    events = table(spark, sf_dir, "events").select("ts", "value", "event_type")
    end = F.lit(STREAM_REFERENCE_END).cast("timestamp_ntz")
    reference = events.where(F.col("ts") < end)
    frozen = stream_drift.FrozenReference.fit(reference, drift.fit_reference(reference, ["value"]), ["event_type"])
    path = f"{work_dir(spark)}/alerts-{uuid.uuid4().hex[:12]}"
    arriving = _stream(spark, table(spark, sf_dir, "events"), sf_dir, "events.parquet").where(F.col("ts") >= end)
    # Every third day the values are moved, so that there is drift to report.
    moved = F.col("value") + F.when(F.dayofmonth("ts") % 3 == 0, F.lit(STREAM_SHIFT)).otherwise(F.lit(0.0))
    arriving = arriving.select("ts", moved.alias("value"), "event_type")
    running = stream_drift.start_drift(arriving, frozen, path, watermark="1 hour", threshold=STREAM_THRESHOLD)
    running.awaitTermination()
    return stream_drift.alerts(spark, path).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        F.array_join("drifted_features", ",").alias("drifted_features"),
        _r("max_psi").alias("max_psi"),
    )


@query
def flagship(spark, sf_dir):
    """Split summary beside the FICO drift between train and test."""
    ref, cur, bins = _sides(spark, sf_dir)
    summary = time_split_summary(spark, sf_dir)
    psi = drift.feature_psi(ref, cur, bins=bins, numeric=["fico_n"], categorical=()).select(_r("psi").alias("psi"))
    return summary.withColumn("fico_psi", psi.scalar())

