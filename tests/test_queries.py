"""Every registered query against its SQL twin on whole tables."""

import pytest

import __spark_entry__ as entry
from siftbook.plans import catalog
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_has_a_twin():
    assert QUERIES.keys() == SQL.keys()


def test_registered():
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["split", "documents", "chunks", "words"]
