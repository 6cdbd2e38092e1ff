import pytest

from __spark_entry__ import entry
from tidemark.catalog.oracle import ORACLE
from tidemark.catalog.queries import registered as queries
from tests.compare import connect, difference

# Queries without a counterpart: files outside the tables, learned models, the whole loop.
ROWS_ONLY = {
    "gbt_calibrated_scores", "gbt_metrics", "score_applications", "global_attribution",
    "row_attribution", "lifecycle_run",
}



def oracle_sql():
    return ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_counterpart_or_a_reason():
    assert set(queries()) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_counterpart(spark, sf_dir, con, name):
    assert difference(queries()[name](spark, sf_dir).toPandas(), con.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY - {"lifecycle_run"}))
def test_rows_only_queries_return_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 3


def test_no_query_multiplies_rows_or_leaves_the_jvm_needlessly(spark, sf_dir):
    with_trees = {"global_attribution", "row_attribution", "forest_attribution", "forest_global"}
    streams = {"stream_psi", "stream_scores", "stream_rejects", "stream_alerts"}
    for name in set(queries()) - streams - {"lifecycle_run", "ledger_current", "csv_round_trip"}:
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
        assert "MapInPandas" not in plan, name
        assert ("MapInArrow" in plan) == (name in with_trees | {"manifest_check"}), name
