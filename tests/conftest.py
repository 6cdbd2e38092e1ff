import os

import pytest

from tidemark.session import local_session
from tidemark.settings import Settings
from tidemark.sources import loans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def raw(spark, sf_dir):
    return loans.raw_loans(spark, sf_dir)


@pytest.fixture(scope="session")
def features(spark, sf_dir):
    return loans.loan_features(spark, sf_dir)


@pytest.fixture
def settings(tmp_path):
    """Settings of an empty data folder, with cut-offs that suit the provided dates."""
    return Settings(root=str(tmp_path), train_end="1998-12-31", valid_end="1999-12-31", roc_auc_min=0.6)


def values(df, *columns):
    """Rows of ``df`` as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def executed_plan(df):
    """The plan as it ran, with what adaptive execution made of it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
