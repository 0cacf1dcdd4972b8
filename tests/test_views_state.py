import datetime as dt
import json

from pyspark.sql import functions as F

from quillgrid.operators import collections, views
from quillgrid.operators.profile import with_profile
from tests import fixtures as fx


def test_views(spark):
    docs = [
        (1, "name,pay\nA,10\nB,20", None, None, 0),
        (2, fx.STATEMENT, "", None, 1),
        (3, "no numbers here", '[{"n":1,"t":"x"}]', None, 2),
        (4, "words", '{"a":[1,2]}', '{"fields":[{"name":"d","type":"date"},{"name":"n","type":"number"}]}', 0),
        (5, "a\nb", '{"only":"text"}', None, 0),
        (6, None, None, None, 0),
        (7, "a\nb", '[{"n":1}]', None, 0),
    ]
    df = spark.createDataFrame(docs, "id int, text string, s string, c string, n int")
    out = views.with_views(with_profile(df, "text"), "text", "s", "c", "n")
    got = {r["id"]: r["views"] for r in out.collect()}
    charts = lambda i: list(got[i]["graphs"]["chart_types"])
    assert [charts(i) for i in range(1, 8)] == [["bar", "pie"], ["bar"], ["bar", "pie"], ["line"], [], [], ["bar"]]
    assert [got[i]["table"]["enabled"] for i in range(1, 8)] == [True, True, True, True, False, False, True]
    assert got[3]["oracle"]["reason"].startswith("Collection has multiple") and got[2]["oracle"]["enabled"]
    assert not got[6]["summary"]["enabled"] and got[6]["explorer"]["enabled"]


def test_chart_data(spark):
    df = spark.createDataFrame([(f"l{i:02d}", float(i)) for i in range(20)], "l string, v double")
    bar = views.bar_data(df, F.col("l"), F.col("v"), 15).collect()
    assert len(bar) == 15 and bar[0]["label"] == "l19"
    pie = {r["label"]: (r["value"], r["percent"]) for r in views.pie_data(df, F.col("l"), F.col("v")).collect()}
    assert len(pie) == 9 and pie["Other"] == (66.0, 34.7)
    spec = views.chart_spec(views.bar_data(df, F.col("l"), F.col("v"), 2), "bar", "T", "v", [F.desc("value")])
    assert json.loads(spec.first()["chart"]) == {
        "type": "bar", "title": "T", "labels": ["l19", "l18"], "datasets": [{"label": "v", "data": [19.0, 18.0]}],
    }


def test_axis(column):
    got = column(views.axis_ticks, [40000.0, 4400.0, 8.0, 0.0], "v double")
    assert [[t["label"] for t in row] for row in got[:3]] == [
        ["40k", "30k", "20k", "10k", "0"], ["4.4k", "3.3k", "2.2k", "1.1k", "0"], ["8", "6", "4", "2", "0"],
    ]
    assert [t["value"] for t in got[3]] == [1.0, 0.75, 0.5, 0.25, 0.0]


def test_axis_labels_round_the_exact_value_halves_to_even(column):
    values = [0.5, 1.5, 2.5, 999.5, 1050.0, 1150.0, 1250.0, 1350.0, 1750.0, 9949.999999999998, 9950.0, 9999.999999999998, 10500.0, 11500.0, 12500.0]
    want = [f"{v / 1000:.0f}k" if v >= 10000 else f"{v / 1000:.1f}k" if v >= 1000 else f"{v:.0f}" for v in values]
    assert column(views.axis_label, values, "v double") == want


def test_insert_upsert_clear(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "x", 3), (3, "z", 5), (3, "y", 4)], "k int, v string, t int")
    got = collections.insert_or_ignore(base, new, ["k"], F.col("t")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 1), (2, "b", 2), (3, "y", 4)]
    upd = spark.createDataFrame([(1, "A", None)], "k int, v string, t int")
    assert sorted(tuple(r) for r in collections.upsert(base, upd, "k", ["v", "t"]).collect()) == [(1, "A", 1), (2, "b", 2)]
    assert [r["k"] for r in collections.clear(base, new, ["k"]).collect()] == [1]


def test_recent_and_latest(spark):
    rows = [(c, i, f"m{i}") for c in "xy" for i in range(30)]
    df = spark.createDataFrame(rows, "c string, i int, t string")
    got = collections.recent(df, ["c"], ["i"], 20).where("c = 'x'").orderBy("place").collect()
    assert [r["i"] for r in got] == list(range(10, 30)) and got[0]["place"] == 1
    last = collections.latest_per(df, "c", ["i"], ["t"]).collect()
    assert {r["c"]: r["t"] for r in last} == {"x": "m29", "y": "m29"}


def test_counts_and_milestones(spark):
    c = spark.createDataFrame([("a",), ("b",)], "k string")
    m = spark.createDataFrame([("a", 1), ("a", 2)], "k string, d int")
    got = collections.collection_counts(c, m, "k", "d").collect()
    assert {r["k"]: r["doc_count"] for r in got} == {"a": 2, "b": 0}
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    ev = [("s", "upload", t(i)) for i in range(6)] + [("s", "save_schema", t(9)), ("s", "other", t(0))]
    df = spark.createDataFrame(ev, "s string, a string, ts timestamp_ntz")
    got = {r["milestone"]: r["earned_at"] for r in collections.milestones(df, "s", "a", "ts").collect()}
    assert got == {"first_upload": t(0), "schema_master": t(9), "power_user": t(4)}


def test_digest_and_listing(spark):
    df = spark.createDataFrame(
        [(1, "a", "r" * 2100, ""), (2, "b", "raw", "{}"), (3, "c", "", None)], "id int, n string, raw string, s string"
    )
    got = {r["doc_id"]: r["block"] for r in collections.digest(df, "id", "n", "raw", "s").collect()}
    assert got[1] == "=== Document #1: a ===\nRaw content:\n" + "r" * 2100 + "\n\n"
    assert got[2] == "=== Document #2: b ===\nStructured data:\n{}\n\n" and got[3] == "=== Document #3: c ===\n"


def test_comparison_in_collections(spark):
    docs = [("a", 1, ["x", "y"]), ("a", 2, ["y", "y", "z"]), ("a", 3, []), ("a", 4, None), ("b", 5, ["x"]), ("b", 6, ["x"]), ("c", 7, [])]
    df = spark.createDataFrame(docs, "c string, d bigint, names array<string>")
    compared = collections.compare_in_collections(df, "c", "names")
    assert sorted((r.collection, r.field, r.documents, r.total_documents, r.shared) for r in compared.collect()) == [
        ("a", "x", 1, 2, False), ("a", "y", 2, 2, True), ("a", "z", 1, 2, False), ("b", "x", 2, 2, True)]
    totals = collections.document_field_totals(df, "d", "c", "names", compared)
    assert sorted((r.doc_id, r.n_fields, r.shared_fields, r.different_fields) for r in totals.collect()) == [
        (1, 2, 1, 1), (2, 2, 1, 1), (3, 0, 0, 0), (4, 0, 0, 0), (5, 1, 1, 0), (6, 1, 1, 0), (7, 0, 0, 0)]
    assert collections.compare_in_collections(df.limit(0), "c", "names").count() == 0
