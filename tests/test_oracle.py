"""Every registered query against DuckDB on the same files."""

import pytest

import __spark_entry__ as entrypoint
from learnlens.plans import catalog
from tests.compare import connect, difference

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# One query per indicator and step runs on the larger set, where every state occurs.
MAIN = [n for n in QUERIES if not any(part in n for part in ("_refresh_", "hourly", "daily", "yearly", "_series", "_counts"))]


@pytest.fixture(scope="module")
def small():
    return connect(SMALL)


@pytest.fixture(scope="module")
def medium():
    return connect(MEDIUM)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in MAIN])
def test_small(spark, small, name):
    assert difference(QUERIES[name](spark, SMALL), small, SQL[name]) is None


@pytest.mark.parametrize("name", MAIN)
def test_medium(spark, medium, name):
    assert difference(QUERIES[name](spark, MEDIUM), medium, SQL[name]) is None


def test_entry(spark):
    assert entrypoint.entry(spark).count() == 36
