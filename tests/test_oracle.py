"""Every registered query against its DuckDB oracle (sf0.001, the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF
from tests.oracle_util import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()
SLOW = {"t5_train_candidates_h1", "t10_feature_importance"}


@pytest.fixture(scope="module")
def con():
    return duck(SF["0.001"])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF["0.001"])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF["0.001"]).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "target_h3" in df.columns
