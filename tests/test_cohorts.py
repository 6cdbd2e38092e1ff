from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import base_rate, cohort_rates, cohort_report, yearly_rates
from tidemark.operators.cohorts import distinct_values, value_shares


def test_base_rate_adds_up(raw):
    row = base_rate(raw).first()
    assert row["n_default"] + row["n_repaid"] == row["n_rows"] == raw.count()
    assert abs(row["base_rate"] - row["n_default"] / row["n_rows"]) < 1e-12


def test_cohorts_are_ordered_and_filtered(raw):
    rows = cohort_rates(raw, "emp_length", min_count=20).collect()
    assert [r["default_rate"] for r in rows] == sorted((r["default_rate"] for r in rows), reverse=True)
    assert min(r["n"] for r in rows) >= 20
    everyone = cohort_rates(raw, "emp_length").collect()
    assert sum(r["n"] for r in everyone) == raw.count() and len(everyone) > len(rows)
    assert "TakeOrderedAndProject" in executed_plan(cohort_rates(raw, "zip_code", top=12))


def test_years_leave_undated_rows_out(raw):
    undated = raw.withColumn("issue_d", F.when(F.col("id") % 10 != 0, F.col("issue_d")).otherwise("soon"))
    rows = yearly_rates(undated).collect()
    assert [r["issue_year"] for r in rows] == sorted(r["issue_year"] for r in rows)
    assert sum(r["n"] for r in rows) == raw.where("id % 10 <> 0").count()


def test_report_is_the_separate_tables_from_one_scan(raw):
    report = cohort_report(raw)
    assert values(report.where("view = 'purpose'"), "cohort", "n", "default_rate") == values(cohort_rates(raw, "purpose"))
    years = yearly_rates(raw).select(F.col("issue_year").cast("string"), "n", "default_rate")
    assert values(report.where("view = 'issue_year'"), "cohort", "n", "default_rate") == values(years)
    plan = executed_plan(report)
    assert plan[: plan.index("Initial Plan")].count("FileScan") == 1
    assert cohort_report(raw, top_purposes=2).where("view = 'purpose'").count() == 2


def test_shares_and_distinct_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("b", None)], "s string, i int")
    assert values(value_shares(df, "s")) == [("__NA__", 1, 0.25), ("a", 2, 0.5), ("b", 1, 0.25)]
    assert values(distinct_values(df, ["s", "i"])) == [("i", 2), ("s", 2)]
    assert values(distinct_values(df, ["s", "i"], approximate=True)) == [("i", 2), ("s", 2)]
