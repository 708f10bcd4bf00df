"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from tessella import queries as core
from tests import bookshop
from tests.compare import SF_DIR, assert_same, folder

QUERIES, SQL = core.queries(), core.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF_DIR), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).columns


@pytest.mark.parametrize("name", sorted(bookshop.QUERIES))
def test_bookshop(spark, name):
    """Line rules and what spans lines in code, on a small project whose rows are worked out by hand."""
    assert_same(bookshop.QUERIES[name](spark, SF_DIR), bookshop.ORACLES[name])


def test_stale_docs_take_rows_as_they_are(spark):
    rows = [(1, "a", "web"), (1, "a", "web"), (2, "b", "web"), (200, "c", "book"), (3, "d", "book")]
    got = QUERIES["m06_stale_docs"](spark, folder(spark, documents=spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert sorted(map(tuple, got.collect())) == [("book", True), ("web", False)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
