"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
import compare
from quillgrid import plans

QUERIES, SQLS = plans.queries(), plans.oracles()
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    ok, note = compare.compare(spark, con, QUERIES[name], SQLS.get(name), data)
    assert ok, note


def test_which_queries_have_no_sql():
    assert set(QUERIES) - set(SQLS) == WITHOUT_SQL
    assert set(SQLS) <= set(QUERIES)


def test_entry_holds_the_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(SQLS) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
