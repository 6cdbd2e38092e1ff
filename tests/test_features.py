import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import FEATURE_COLUMNS, RAW_INPUT_COLUMNS, apply_scenario, build_feature_matrix, engineer_features
from tidemark.functions import columns as fx


def column(spark, items, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, c {kind}").orderBy("i")


def apply(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_emp_length(spark):
    items = [" <1", "2 years", "7 yrs", "10+", "n/a", None, " NI ", "", "NA", "about 3 or 4", "long", "<NA>"]
    found = apply(column(spark, items, "string"), fx.emp_length_years(F.col("c")))
    assert found == [0.0, 2.0, 7.0, 10.0, None, None, None, None, None, 3.0, None, 0.0]


def test_numeric_coercion(spark):
    df = column(spark, ["1.5", " 12 ", "1e3", "abc", "", "nan", None, "1.5d", "2F"], "string")
    assert apply(df, fx.numeric(df, "c")) == [1.5, 12.0, 1000.0, None, None, None, None, None, None]
    df = column(spark, [1.0, float("nan"), None], "double")
    assert apply(df, fx.numeric(df, "c")) == [1.0, None, None]


def test_safe_ratio(spark):
    df = spark.createDataFrame(
        [(0, 10.0, 4.0), (1, 10.0, 0.0), (2, None, 4.0), (3, 10.0, None), (4, float("inf"), 2.0), (5, 1e308, 1e-308)],
        "i int, a double, b double",
    ).orderBy("i")
    assert apply(df, fx.safe_ratio(F.col("a"), F.col("b"))) == [2.5, None, None, None, None, None]


def test_text_flags_use_unicode_blanks_and_code_points(spark):
    items = [None, "", "  ", "　\t\n", "\x1c\x1f", " ", " a ", "日本語", "😀"]
    df = column(spark, items, "string")
    assert apply(df, fx.has_text(F.col("c"))) == [0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert [bool((s or "").strip()) for s in items] == [bool(x) for x in apply(df, fx.has_text(F.col("c")))]
    assert apply(df, fx.text_length(F.col("c"))) == [len(s or "") for s in items]
    assert apply(df, fx.stripped(F.col("c"))) == [s and s.strip() for s in items]


def test_month_parse(spark):
    found = apply(column(spark, ["Dec-2015", "dec-2015", "Foo-2015", "2015-12", None, "Jan-2007"], "string"), fx.month_start(F.col("c")))
    assert found == [dt.date(2015, 12, 1), dt.date(2015, 12, 1), None, None, None, dt.date(2007, 1, 1)]


def test_typed_date_wins_over_the_month(spark):
    df = spark.createDataFrame([("Dec-2015", dt.date(2016, 2, 1)), ("Dec-2015", None)], "issue_d string, issue_date date")
    assert apply(df, fx.issue_date(df, typed="issue_date", raw="issue_d")) == [dt.date(2016, 2, 1), None]
    bare = df.drop("issue_date")
    assert apply(bare, fx.issue_date(bare, typed="issue_date", raw="issue_d")) == [dt.date(2015, 12, 1)] * 2


def test_categories_and_bands(spark):
    assert apply(column(spark, ["x", None], "string"), fx.category(F.col("c"))) == ["x", "__NA__"]
    bands = apply(column(spark, [0.1499, 0.15, 0.2999, 0.3, 0.9], "double"), fx.risk_band(F.col("c")))
    assert bands == ["Lower risk", "Moderate risk", "Moderate risk", "Higher risk", "Higher risk"]
    assert apply(column(spark, [0.2, 0.0, -0.2], "double"), fx.push_direction(F.col("c"))) == [
        "toward default", "toward repaying", "toward repaying",
    ]


def test_feature_table_schema(raw):
    frame = engineer_features(raw)
    assert frame.columns == ["id", *FEATURE_COLUMNS, "Default", "issue_date"]
    kinds = dict(frame.dtypes)
    assert {kinds[c] for c in ("has_desc", "has_title", "Default")} == {"tinyint"}
    assert {kinds[c] for c in ("desc_len", "title_len")} == {"int"}
    assert {kinds[c] for c in FEATURE_COLUMNS[:7]} == {"double"}
    assert frame.where("isnan(revenue) or isnan(loan_to_income) or isnan(dti_n)").isEmpty()


@pytest.mark.parametrize("bad", [None, "yes"])
def test_bad_target_fails_the_job(raw, bad):
    broken = raw.withColumn("Default", F.lit(bad).cast("string"))
    with pytest.raises(PySparkException):
        engineer_features(broken).collect()


def test_feature_job_reads_only_what_it_needs(spark, raw):
    plan = executed_plan(build_feature_matrix(raw).select("fico_n", "has_title").limit(3))
    schema = plan[plan.index("ReadSchema: "):].splitlines()[0]
    assert "fico_n" in schema and "title" in schema
    assert "desc" not in schema and "loan_amnt" not in schema
    assert "Python" not in executed_plan(build_feature_matrix(raw))


def test_scenario_touches_only_what_is_there(spark):
    df = spark.createDataFrame([(700.0, 10.0, 1000.0, 500.0)], "fico_n double, dti_n double, revenue double, loan_amnt double")
    row = apply_scenario(df).first()
    assert row.asDict() == {"fico_n": 640.0, "dti_n": 16.0, "revenue": 600.0, "loan_amnt": 500.0, "loan_to_income": 500 / 600}
    assert apply_scenario(df.select("fico_n")).columns == ["fico_n"]
    assert apply_scenario(df.select("loan_amnt")).first()[0] == 500.0
    none = df.select("revenue", "loan_amnt").withColumn("revenue", F.lit(0.0))
    assert apply_scenario(none).first()["loan_to_income"] is None


def test_feature_values_of_one_application(spark):
    row = dict.fromkeys(RAW_INPUT_COLUMNS)
    row |= {
        "revenue": "65000", "dti_n": 16.06, "loan_amnt": 24700.0, "fico_n": 717.0, "experience_c": 1,
        "emp_length": "10+ years", "purpose": "small_business", "home_ownership_n": "MORTGAGE",
        "addr_state": "SD", "zip_code": None, "title": "Business", "desc": "",
    }
    schema = ", ".join(f"`{c}` {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for c, v in row.items())
    found = build_feature_matrix(spark.createDataFrame([tuple(row.values())], schema)).first().asDict()
    assert found["revenue"] == 65000.0 and found["loan_to_income"] == 24700 / 65000
    assert (found["has_desc"], found["desc_len"], found["has_title"], found["title_len"]) == (0, 0, 1, 8)
    assert found["zip_code"] == "__NA__" and found["emp_length_years"] == 10.0
    assert values(spark.createDataFrame([(1,)], "a int")) == [(1,)]
