"""The most frequent values, against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import heavy


def plain(rows, columns, k):
    out = {}
    for i, c in enumerate(columns):
        counts = Counter(str(r[i]).strip() for r in rows if r[i] is not None and str(r[i]).strip())
        best = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:k]
        out |= {(c, j + 1): e for j, e in enumerate(best)}
    return out


def found(df):
    return {(r["field"], r["rank"]): (r["value"], r["n"]) for r in df.collect()}


@pytest.mark.parametrize("tracked,buckets", [(1000, 65536), (8, 4), (4, 1)])
def test_top_values(spark, tracked, buckets):
    rnd = random.Random(5)
    rows = [(int(rnd.paretovariate(0.7)), rnd.choice("ab "), i, None) for i in range(3000)] + [(7, " a", None, None), (7, None, 1, "")]
    df = spark.createDataFrame(rows, "skewed long, few string, `not.twice` long, absent string")
    columns = ["skewed", "few", "not.twice", "absent"]
    assert found(heavy.top_values(df, columns, 4, tracked, buckets)) == plain(rows, columns, 4)


def test_bad_candidates_cost_nothing_but_work(spark):
    """The result doesn't rest on the sketch: with useless candidates the open buckets hold the values."""
    cells = spark.createDataFrame([("f", v) for v in "aaabbc"], "field string, value string")
    counted = heavy.count_in_buckets(cells, spark.createDataFrame([("f", "c")], "field string, value string"), 8)
    assert {r["value"]: r["n"] for r in counted.where("bucket IS NULL").collect()} == {"c": 1}
    assert counted.where("bucket IS NOT NULL").agg(F.sum("n")).first()[0] == 5
    assert heavy.open_buckets(counted, 1).count() == counted.where("bucket IS NOT NULL").count()


def test_clear_winners_close_all_buckets(spark):
    rows = [("f", "x")] * 50 + [("f", str(i)) for i in range(40)]
    cells = spark.createDataFrame(rows, "field string, value string")
    counted = heavy.count_in_buckets(cells, spark.createDataFrame([("f", "x")], "field string, value string"), 4096)
    assert heavy.open_buckets(counted, 1).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b long")
    assert heavy.top_values(df, ["a", "b"], 3).count() == 0


def test_top_values_shuffles_no_distinct_values_of_closed_columns(spark):
    """What the counting pass hands on is bounded by candidates and buckets, whatever the number of distinct values."""
    cells = heavy.value_cells(spark.range(20000).selectExpr("id AS v"), ["v"])
    counted = heavy.count_in_buckets(cells, heavy.candidates(cells, 16), 32)
    assert counted.count() <= 16 + 32
