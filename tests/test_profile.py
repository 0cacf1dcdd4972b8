import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import discovery, profile, quantiles
from tests import fixtures as fx


def run(spark, texts, strict=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = profile.with_clean_report(profile.with_profile(df, "text", strict), "text").orderBy("id").collect()
    return out


def test_csv_profile(spark):
    r = run(spark, ["part,weight,contact\nbolt,7,\nnut,2.5,q@yard.test\nbolt,,\n,9,w@yard.test"])[0]
    assert (r["doc_type"], r["row_count"], r["field_count"]) == ("csv", 4, 3)
    part, weight, contact = r["fields"]
    assert part["nullable"] and part["empty_count"] == 1 and not part["unique"]
    assert weight["type"] == "number" and weight["unique"] and contact["type"] == "email"
    assert part["sample_values"] == ["bolt", "nut", "bolt"] and weight["sample_values"] == ["7", "2.5", "9"]
    assert r["issues"] == ["part: 1 empty values (25%)", "weight: 1 empty values (25%)", "contact: 2 empty values (50%)"]
    assert r["clean"]["empty_values"] == 4 and r["clean"]["total_values"] == 12
    assert r["clean"]["email_values"] == 2
    assert r["clean"]["suggestions"][0].startswith("Data has 33% missing values")


def test_object_samples_are_whole(spark):
    text = '{"k":["' + "é" * 150 + '"],"s":"t"}'
    df = spark.createDataFrame([(0, text)], "id int, text string")
    whole = profile.with_profile(df, "text").first()["fields"]
    assert [f["sample_values"] for f in whole] == [['["' + "é" * 150 + '"]'], ['"t"']]
    short = profile.with_profile(df, "text", sample_length=20).first()["fields"]
    assert [f["sample_values"] for f in short] == [['["' + "é" * 18 + "..."], ['"t"']]


def test_json_profile(spark):
    rows = run(
        spark,
        ['[{"a":1,"b":null},{"a":"x"},{"a":2,"c":true}]', '{"k":{"x":1},"s":"t"}', "[]", "[1,2]", "plain words"],
    )
    a, b, c = rows[0]["fields"]
    assert (rows[0]["row_count"], rows[0]["field_count"]) == (3, 3)
    assert a["type"] == "mixed" and a["sample_values"] == ["1", '"x"', "2"] and a["missing_count"] == 0
    assert b["type"] == "null" and b["empty_count"] == 1 and b["missing_count"] == 2
    assert c["type"] == "boolean"
    assert rows[1]["row_count"] == 1 and [f["type"] for f in rows[1]["fields"]] == ["string", "string"]
    assert rows[2]["issues"] == ["Could not parse JSON structure"] == rows[3]["issues"]
    assert rows[4]["issues"] == ["Schema inference is not available for this document type"]


def test_messy_people(spark):
    strict = run(spark, [fx.PEOPLE], strict=True)[0]
    assert strict["fields"] == [] and strict["issues"] == ["Could not parse CSV"]
    loose = run(spark, [fx.PEOPLE])[0]
    by = {f["name"]: f for f in loose["fields"]}
    assert loose["row_count"] == 7 and list(by) == ["Email", "Start Date", "City", "Name", "Salary", "Age"]
    assert by["Age"]["type"] == "number" and by["City"]["type"] == "string" and by["Name"]["empty_count"] == 1
    assert loose["clean"]["mixed_type_columns"] == ["Email", "Start Date", "Salary"]


def test_missing_header_and_ragged_rows(spark):
    r = run(spark, ["a,,c\n1,2,3\n1,2"])[0]
    assert [f["name"] for f in r["fields"]] == ["a", "column_2", "c"]
    assert r["issues"] == [
        "Column 2 has no header name", "c: 1 empty values (50%)", "1 rows differ from the header in field count",
    ]


def test_table_profile_agrees_with_document_profile(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", "x", "5", "n/a"]), str(i), rng.choice(["1", "2"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string")
    counts = profile.value_counts(df, "k", ["a", "b", "c"])
    got = {r["field"]: r for r in profile.profile_values(counts).collect()}
    doc = "a,b,c\n" + "\n".join(",".join(r[1:]) for r in rows)
    want = {f["name"]: f for f in run(spark, [doc])[0]["fields"]}
    for name in "abc":
        for k in ("type", "nullable", "unique", "empty_count"):
            assert got[name][k] == want[name][k], (name, k)
    first = profile.first_values(profile.cells_of(df, "k", ["a", "b", "c"])).orderBy("field", "rank").collect()
    for i, name in enumerate("abc", 1):
        assert [r["value"] for r in first if r["field"] == name] == [r[i] for r in rows if r[i] != ""][:3], name


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    n = 4000
    cols = {
        "even": rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.9, 7.0, rng.random(n) * 50), "two": np.where(rng.random(n) < 0.5, 1.0, 2.0),
        "few": rng.integers(0, 5, n).astype(float), "split": np.where(np.arange(n) < 1000, 0.0, 10.0),
        "wide": np.exp(np.clip(rng.normal(size=n), -3, 3) * 200) * rng.choice([-1, 1], n), "tiny": rng.random(n) * 5e-310, "close": 1.0 + rng.integers(0, 9, n) * 2.0 ** -52,
    }
    names = list(cols)
    df = spark.createDataFrame([tuple(float(x) for x in t) for t in zip(*cols.values())], [*names]).withColumn("none", F.lit(None).cast("double"))
    ps = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {(r["field"], r["p"]): r["value"] for r in quantiles.quantiles(df, [*names, "none"], ps).collect()}
    for c in names:
        assert np.allclose([got[c, p] for p in ps], np.percentile(cols[c], [100 * p for p in ps]), rtol=1e-12, atol=0), c
    assert len(got) == len(names) * len(ps)


def test_order_key(spark):
    values = sorted({0.0, -0.0, 1.0, 1.5, 2.0 - 2 ** -52, 2.0, 3.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1e300, 0.1, 0.3, 1 / 3, 2.0 ** 52 - 1, 2.0 ** 53, 1e15,
                     *(2.0 ** k for k in range(-1074, 1024, 7)), *(float(np.nextafter(2.0 ** k, 0)) for k in range(-1070, 1024, 7))})
    values = [float("-inf"), *(-v for v in reversed(values[1:])), *values, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    keys = [r["k"] for r in df.select("i", quantiles.order_key(F.col("v")).alias("k")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:]))
    assert {r["k"] for r in spark.createDataFrame([(-0.0,), (0.0,)], "v double").select(quantiles.order_key(F.col("v")).alias("k")).collect()} == {0}


def test_outliers_run_nothing_while_they_are_built(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, 99.0)], "k int, v double")
    for name in ("collect", "first", "count", "toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("an eager read"))
    profile.outliers(df, "k", ["v"])


def test_outliers_and_references(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, 99.0)], "k int, v double")
    out = profile.outliers(df, "k", ["v"]).collect()
    assert [(r["row_key"], r["field"]) for r in out] == [(100, "v")]
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "c int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    r = profile.references(child, "c", parent, "p").first()
    assert r["references"] and r["child_values"] == 2 and r["orphans"] == 0
    r = profile.references(parent, "p", child.where(F.col("c").isNotNull()), "c").first()
    assert not r["references"] and r["orphans"] == 1


def test_reference_discovery(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, "y", 2.5), (3, None, None), (3, "y", 2.5)], "k int, s string, d double")
    b = spark.createDataFrame([(2, "y", [1]), (1, "x", [2]), (None, "z", None), (9, "w", [3])], "`k.b` bigint, s string, nested array<int>")
    c = spark.createDataFrame([], "k int, s string")
    got = {(r["child_table"], r["child"], r["parent_table"], r["parent"]): r for r in discovery.reference_candidates({"a": a, "b": b, "c": c}).collect()}
    values = {"a": {"k": [1, 2, 3, 3], "s": ["x", "y", "y"]}, "b": {"k.b": [2, 1, 9], "s": ["y", "x", "z", "w"]}}
    for ct, cc, pt, pc in [("a", "k", "b", "k.b"), ("b", "k.b", "a", "k"), ("a", "s", "b", "s"), ("b", "s", "a", "s")]:
        child, parent = values[ct][cc], values[pt][pc]
        if min(parent) <= min(child) and max(child) <= max(parent):
            r = got.pop((ct, cc, pt, pc))
            orphans = len(set(child) - set(parent))
            assert (r.child_values, r.orphans, r.shared_values) == (len(set(child)), orphans, len(set(child) & set(parent)))
            assert r.parent_unique == (len(parent) == len(set(parent))) and r.is_reference == (r.parent_unique and not orphans)
    assert not got
    assert discovery.reference_candidates({"c": c}).count() == 0


def test_discovery_meets_each_value_once(spark):
    t = {n: spark.range(50).withColumn("id2", F.col("id") + 5) for n in "abc"}
    plan = discovery.reference_candidates(t)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("hashpartitioning(kind") <= 4


def test_typed_facts(spark):
    rows = [("a", "$1,000", 2), ("a", "4", 1), ("a", "x", 9), ("a", "", 3), ("b", "2024-01-02", 2), ("b", "2023-05-06", 1), ("c", "n/a", 4)]
    got = {r["field"]: r for r in profile.typed_facts(spark.createDataFrame(rows, "field string, value string, n bigint")).collect()}
    assert (got["a"].n, got["a"].low, got["a"].high, got["a"].mean) == (3, 4.0, 1000.0, 2004 / 3)
    assert (str(got["b"].first_day), str(got["b"].last_day), got["b"].low) == ("2023-05-06", "2024-01-02", None)
    assert "c" not in got
