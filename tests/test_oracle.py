"""Every registered query against independent SQL, row by row, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from revlens.catalog.oracle import ORACLE
from revlens.catalog.queries import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_agrees_with_sql(spark, con, key):
    assert difference(spark, con, QUERIES[key], ORACLE[key], FOLDER) is None


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "severity" in rows.columns
