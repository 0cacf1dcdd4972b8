"""The registered queries of the package against their SQL in DuckDB; those without SQL give rows."""

import pytest

import compare
from quillgrid.llm import queries

WITH_SQL = {"op2_chat_format", "op11_prefix_trie"}


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, data, name):
    ok, note = compare.compare(spark, con, queries.queries()[name], queries.oracles().get(name), data)
    assert ok, note


def test_which_queries_have_sql():
    assert set(queries.oracles()) == WITH_SQL
