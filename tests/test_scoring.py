import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tidemark import FEATURE_COLUMNS, LeakageError, ModelParams, RAW_INPUT_COLUMNS, score_batch, validate_applications
from tidemark.plans.model import calibrate, fit_base
from tidemark.plans.scoring import DEFAULTS, REQUIRED

APPLICATION = {
    "revenue": 48250.0, "dti_n": 21.4, "loan_amnt": 9600.0, "fico_n": 683.0, "experience_c": 0, "emp_length": "4 years",
    "purpose": "car", "home_ownership_n": "RENT", "addr_state": "OR", "zip_code": "974xx",
    "title": "Van for deliveries", "desc": "second vehicle",
}


def applications(spark, *changes, drop=()):
    rows = [{**APPLICATION, "id": i, **c} for i, c in enumerate(changes)]
    kinds = {float: "double", int: "int", str: "string"}
    schema = ", ".join(f"`{c}` {kinds[type(v)] if c != 'id' else 'long'}" for c, v in {**APPLICATION, "id": 0}.items())
    df = spark.createDataFrame([tuple(r[c] for c in [*APPLICATION, "id"]) for r in rows], schema)
    return df.drop(*drop)


@pytest.fixture(scope="module")
def model(features):
    dated = features.where("emp_length_years is not null").drop("split")
    params = ModelParams(n_estimators=3, max_depth=3, learning_rate=0.3)
    return calibrate(fit_base(dated.where("issue_date <= '1998-12-31'"), params), dated.where("issue_date > '1998-12-31'"))


def test_bounds_and_required_fields(spark):
    checked = validate_applications(
        applications(spark, {}, {"revenue": 0.0}, {"revenue": -1.0}, {"loan_amnt": 0.0}, {"fico_n": None, "purpose": None}, {"title": None, "desc": None})
    )
    assert values(checked.accepted, "id") == [(0,), (1,), (5,)]
    errors = {r["id"]: r["errors"] for r in checked.rejected.collect()}
    assert errors == {2: ["revenue: must be >= 0"], 3: ["loan_amnt: must be > 0"], 4: ["fico_n: required", "purpose: required"]}


def test_defaults_are_filled_in(spark):
    left_out = validate_applications(applications(spark, {}, drop=("experience_c", "emp_length", "title", "desc"))).accepted.first()
    null = validate_applications(applications(spark, {"experience_c": None, "emp_length": None})).accepted.first()
    for row in (left_out, null):
        assert {c: row[c] for c in DEFAULTS} == DEFAULTS
    assert left_out["title"] is None


def test_text_that_is_no_number_is_rejected(spark):
    df = applications(spark, {}, {}).withColumn("fico_n", F.when(F.col("id") == 0, "717").otherwise("good"))
    checked = validate_applications(df)
    assert values(checked.accepted, "id") == [(0,)]
    assert checked.rejected.first()["errors"] == ["fico_n: not a number"]


@pytest.mark.parametrize("extra", ["int_rate", "loan_status", "Default", "favourite_colour"])
def test_schema_is_closed(spark, extra):
    with pytest.raises(LeakageError, match=extra):
        validate_applications(applications(spark, {}).withColumn(extra, F.lit(1)))


def test_lacking_fields_refuse_the_batch(spark):
    with pytest.raises(KeyError, match="fico_n"):
        validate_applications(applications(spark, {}).select("id", "revenue"))
    assert set(REQUIRED) < set(RAW_INPUT_COLUMNS)


def test_scores_with_and_without_explanation(spark, model):
    accepted = validate_applications(applications(spark, {}, {"emp_length": "< 1 year"})).accepted
    plain = score_batch(accepted, model, version=3, stage="Production")
    assert plain.columns == ["id", "default_probability", "risk_band", "model_version", "model_stage"]
    for r in plain.collect():
        assert 0 <= r["default_probability"] <= 1 and (r["model_version"], r["model_stage"]) == (3, "Production")
    explained = score_batch(accepted, model, version=3, stage="Production", explain=True, top_n=4)
    assert values(explained, "id", "default_probability") == values(plain, "id", "default_probability")
    for r in explained.collect():
        assert r["n_features"] == 15 and len(r["top_contributions"]) == 4
        assert {c["feature"] for c in r["top_contributions"]} <= set(FEATURE_COLUMNS)
        sizes = [abs(c["shap"]) for c in r["top_contributions"]]
        assert sizes == sorted(sizes, reverse=True)


def test_batch_scores_equal_stored_feature_scores(model, raw, features):
    direct = score_batch(validate_applications(raw.select("id", *RAW_INPUT_COLUMNS)).accepted, model, version=1, stage="None")
    stored = model.score(features).select("id", F.col("score").alias("default_probability"))
    accepted = direct.select("id", "default_probability")
    assert accepted.exceptAll(stored).isEmpty() and accepted.count() > 1000
