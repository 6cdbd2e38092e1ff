import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark import FEATURE_COLUMNS, RAW_INPUT_COLUMNS, LeakageError, Settings, assert_lineage, assert_no_leakage
from tidemark import build_feature_matrix, engineer_features, feature_columns_of, get_xy, load_contract
from tidemark.contract import DEFAULT_CONTRACT, contract_hash
from tidemark.contract import Leaks, find_leaks, provenance
from tidemark.operators.split import rows_only_in_one

LEAKS = ["int_rate", "grade", "sub_grade", "loan_status", "total_pymnt", "recoveries", "last_pymnt_d"]


def test_lists_are_disjoint_and_roles_banned():
    contract = load_contract()
    assert contract.allowed.isdisjoint(contract.banned)
    assert set(RAW_INPUT_COLUMNS) == contract.allowed
    assert set(contract.role_columns) <= contract.banned
    assert contract.banned.isdisjoint(FEATURE_COLUMNS)
    assert_no_leakage(FEATURE_COLUMNS, consumed=RAW_INPUT_COLUMNS)


def test_hash_is_of_the_file_bytes():
    want = hashlib.sha256(DEFAULT_CONTRACT.read_bytes()).hexdigest()
    assert contract_hash() == load_contract().config_hash == want


@pytest.mark.parametrize(
    "broken, message",
    [("banned_columns: [Default, id, issue_d]", "role columns"), ("banned_columns: [Default, id, issue_d, issue_date, revenue]", "both")],
)
def test_inconsistent_contract_is_refused(tmp_path, broken, message):
    text = DEFAULT_CONTRACT.read_text()
    path = tmp_path / "contract.yaml"
    path.write_text(text[: text.index("banned_columns")] + broken + "\n")
    with pytest.raises(LeakageError, match=message):
        load_contract(str(path))


@pytest.mark.parametrize("column", [*LEAKS, "Default", "issue_d", "issue_date", "id"])
def test_guard_refuses_every_banned_column(column):
    with pytest.raises(LeakageError, match="banned"):
        assert_no_leakage([*FEATURE_COLUMNS, column])


def test_guard_refuses_unlisted_input():
    with pytest.raises(LeakageError, match="int_rate feeds features"):
        assert_no_leakage(FEATURE_COLUMNS, consumed=[*RAW_INPUT_COLUMNS, "int_rate"])


def test_features_do_not_depend_on_outcome_columns(raw):
    poisoned = raw.withColumns({"int_rate": F.lit(13.5), "grade": F.lit("C"), "recoveries": F.col("loan_amnt")})
    clean, dirty = (build_feature_matrix(d, keep=("id",)) for d in (raw, poisoned))
    assert load_contract().banned.isdisjoint(feature_columns_of(dirty))
    assert rows_only_in_one(clean, dirty).isEmpty()


def test_get_xy_looks_at_the_columns_of_the_frame(features):
    frame = features.drop("split")
    assert get_xy(frame).columns == [*FEATURE_COLUMNS, "Default"]
    with pytest.raises(LeakageError, match="banned"):
        get_xy(frame.withColumn("int_rate", F.lit(13.5)))


def test_missing_raw_column_fails_fast(raw):
    with pytest.raises(KeyError, match="revenue"):
        engineer_features(raw.drop("revenue"))


def test_only_metadata_may_be_kept(raw):
    with pytest.raises(LeakageError, match="metadata"):
        build_feature_matrix(raw, keep=("issue_d",))


def test_lineage_finds_a_renamed_leak(spark, raw, tmp_path):
    assert_lineage(engineer_features(raw))
    path = str(tmp_path / "leaky.parquet")
    raw.withColumn("int_rate", F.rand(1)).write.parquet(path)
    leaky = spark.read.parquet(path).drop("dti_n").withColumnRenamed("int_rate", "dti_n")
    with pytest.raises(LeakageError, match="int_rate"):
        assert_lineage(engineer_features(leaky))


def test_leaks_are_told_apart(spark, raw, tmp_path):
    """Renamed, joined, computed in passing, unioned or from a subquery: a leak. Filtered: no column of it."""
    path = str(tmp_path / "leaky.parquet")
    raw.withColumn("int_rate", F.rand(1)).write.parquet(path)
    leaky = spark.read.parquet(path)
    rates = leaky.select(F.col("id").alias("other"), F.col("int_rate").alias("r"))
    joined = leaky.drop("dti_n", "int_rate").join(rates, F.col("id") == F.col("other")).withColumnRenamed("r", "dti_n")
    window = leaky.withColumn("dti_n", F.expr("avg(int_rate) over (partition by purpose)"))
    grouped = leaky.groupBy(*[c for c in raw.columns if c != "dti_n"]).agg(F.max("int_rate").alias("dti_n"))
    scalar = leaky.withColumn("dti_n", leaky.agg(F.max("int_rate")).scalar())
    both = raw.select("*").unionByName(leaky.withColumn("dti_n", F.col("int_rate")).select(*raw.columns))
    exploded = leaky.withColumn("dti_n", F.explode(F.array("int_rate", "dti_n")))
    for frame in (leaky.drop("dti_n").withColumnRenamed("int_rate", "dti_n"), joined, window, grouped, scalar, both, exploded):
        found = find_leaks(engineer_features(frame))
        assert ("dti_n", "int_rate") in found.computed and {c for c, _ in found.computed} == {"dti_n"}, frame.columns
    filtered = find_leaks(engineer_features(leaky.where("int_rate > 0.5")))
    assert filtered.computed == () and filtered.selecting == ("int_rate",)
    semi = find_leaks(engineer_features(leaky.join(rates.where("r > 0.5"), F.col("id") == F.col("other"), "left_semi")))
    assert semi.computed == () and semi.selecting == ("int_rate",)
    assert find_leaks(engineer_features(leaky)) == find_leaks(engineer_features(raw)) == Leaks((), ())
    assert provenance(leaky.selectExpr("int_rate + dti_n as x", "1 as y")).computed == {"x": {"int_rate", "dti_n"}, "y": frozenset()}


def test_settings_from_variables():
    found = Settings.from_env({"TIDEMARK_PSI_THRESHOLD": "0.3", "TIDEMARK_SEED": "7", "OTHER": "x"})
    assert (found.psi_threshold, found.seed, found.roc_auc_min) == (0.3, 7, 0.67)
    with pytest.raises(ValueError, match="before"):
        Settings(train_end="2017-01-01", valid_end="2016-12-31")
