"""Every query with a SQL statement gives the rows of that statement."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, differences
from conftest import SMALL

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, con, name):
    assert differences(entry_point.queries()[name](spark, SMALL), con, ORACLES[name]) == []


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(ORACLES)))
def test_fitted_models_give_rows(spark, name):
    assert entry_point.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
