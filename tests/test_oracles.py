"""Every registered query against its DuckDB counterpart over the smallest data."""

import pytest
from tests.conftest import SAMPLE

import __spark_entry__ as driver
from checks.compare import database, difference
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return database(SAMPLE)


@pytest.mark.parametrize("name", QUERIES)
def test_equal_to_duckdb(spark, connection, name):
    assert name in driver.queries() and name in driver.oracle_sql()
    assert difference(spark, connection, SAMPLE, name) is None


def test_entry_has_rows(spark):
    assert not driver.entry(spark).isEmpty()
