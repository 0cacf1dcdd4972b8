"""Properties of physical plans that results cannot show."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgrid.functions.text import doc_type
from quillgrid.operators import collections, exports, parsers, profile, quality, search
from quillgrid.plans import search_plans
from quillgrid.sources import chunk_index
from quillgrid.sources.files import table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


PER_DOCUMENT = {
    "types": lambda d: d.select(doc_type(F.col("text"))),
    "profile": lambda d: profile.profile_fields(profile.with_profile(d, "text"), "doc_id"),
    "clean": lambda d: profile.with_clean_report(profile.with_profile(d, "text"), "text"),
    "quality": lambda d: quality.with_quality(d, "text", "text"),
    "chunks": lambda d: search.term_counts(search.with_tokens(search.chunk(d, "doc_id", "source", "text"))),
    "grep": lambda d: search.grep(d, "doc_id", "text", None, "a"),
    "entities": lambda d: parsers.entities(d, "doc_id", "text"),
    "rows": lambda d: exports.rows(d, "doc_id", "text"),
    "csv": lambda d: exports.documents_as(d, "doc_id", "text", "csv", ""),
}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_per_document_work_needs_no_shuffle_and_no_python(docs, name):
    plan = plan_of(PER_DOCUMENT[name](docs))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("FileScan") == 1


def test_lookup_reaches_the_scan(spark, data):
    plan = plan_of(collections.lookup(table(spark, data, "orders"), "o_orderkey", 42).select("o_custkey"))
    assert "EqualTo(o_orderkey,42)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_listing_reads_light_columns_only(spark, data):
    plan = plan_of(entry.queries()["list_documents"](spark, data))
    assert "Limit" not in plan and "TakeOrdered" not in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_ranking_reads_asked_terms_and_limits_groups_early(spark, data):
    index = search_plans.index(spark, data)
    plan = plan_of(chunk_index.ranked(spark, index, [("q", "the then")], 5))
    assert "In(term, [the,then])" in plan and "content" not in plan
    assert plan.count("WindowGroupLimit") == 2 and "BroadcastHashJoin" in plan


def test_group_limits_before_the_shuffle(spark, data):
    for name in ("recent_turns", "profile_first_values", "milestones"):
        assert "Partial" in plan_of(entry.queries()[name](spark, data)).split("WindowGroupLimit", 1)[1], name
