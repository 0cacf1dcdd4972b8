import json
import random
import time

from pyspark.sql import functions as F

from quillgrid.functions import jsontext
from quillgrid.operators import exports, quality
from tests import fixtures as fx


def on_json(fn):
    return lambda c: fn(jsontext.strict(c))


def random_value(rng, depth=0):
    roll = rng.random()
    if depth > 4 or roll < 0.35:
        return rng.choice([None, "", "text", 'q"uo:te', "a\\", 5, 1.5, True, "{", "x:null", ":"])
    if roll < 0.65:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    keys = rng.sample(["a", "b_c", "camelKey", "Other", "k.l", "n:ull", ""], rng.randint(0, 4))
    return {k: random_value(rng, depth + 1) for k in keys}


def random_docs(n=150, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v = random_value(rng)
        if rng.random() < 0.4:
            v = [random_value(rng, 2) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            v = [{k: random_value(rng, 3) for k in rng.sample("abcd", rng.randint(0, 4))} for _ in range(3)]
        out.append(json.dumps(v, ensure_ascii=False))
    return out


def test_strict_validity(column):
    cases = {
        '{"a":1}': True, "[1,2]": True, '{"a":1} x': False, "[1],[2]": False, '{"a":1,}': False, "": False,
        ' {"a": 1}\n': True, "null": True, '1},{"v":2': False, '"s"': True, "{'a':1}": False,
    }
    got = column(lambda c: jsontext.strict(c).isNotNull(), list(cases))
    assert dict(zip(cases, got)) == cases


def test_duplicate_keys_last_wins(column):
    assert column(on_json(F.to_json), ['{"a":1,"a":2}']) == ['{"a":2}']


def naive_completeness(v):
    seen = {"all": 0, "gone": 0}

    def visit(x):
        if isinstance(x, dict):
            for m in x.values():
                seen["all"] += 1
                if m is None or m == "" and isinstance(m, str):
                    seen["gone"] += 1
                else:
                    visit(m)
        elif isinstance(x, list):
            for m in x:
                visit(m)

    visit(v)
    return 50 if not seen["all"] else 100 - seen["gone"] * 100 // seen["all"]


def naive_depth(o):
    best = 1
    for m in o.values():
        if isinstance(m, dict):
            best = max(best, naive_depth(m) + 1)
        elif isinstance(m, list) and m:
            best = max(best, naive_depth(m[0]) + 2 if isinstance(m[0], dict) else 2)
    return best


def naive_structure(v):
    if isinstance(v, list):
        if not v:
            return 30
        if not isinstance(v[0], dict):
            return 55
        return 95 if naive_depth(v[0]) >= 2 else 85
    if isinstance(v, dict):
        if not v:
            return 20
        arrays = any(isinstance(m, list) for m in v.values())
        d = naive_depth(v)
        return 95 if arrays and d >= 3 else 85 if arrays else 75 if d >= 2 else 60
    return 30


def is_records(v):
    return isinstance(v, list) and all(m is None or isinstance(m, dict) for m in v)


def naive_consistency(v):
    def of_rows(rows):
        keys = set(rows[0] or {})
        shares = [len(keys & set(r or {})) * 100 // len(keys) if keys else 0 for r in rows[1:]]
        return sum(shares) // len(shares)

    if is_records(v) and len(v) > 1:
        return of_rows(v)
    if isinstance(v, dict):
        for k in sorted(v):
            if is_records(v[k]) and len(v[k]) > 1:
                return of_rows(v[k])
        snake = sum("_" in k for k in v)
        camel = sum("_" not in k and k[:1].islower() for k in v)
        return 70 if not v else 50 + max(snake, camel) * 50 // len(v)
    return 70 if v is None else 60


def test_scores_match_plain_python(column):
    docs = random_docs()
    values = [json.loads(d) for d in docs]
    assert column(on_json(quality.completeness), docs) == [naive_completeness(v) for v in values]
    assert column(on_json(quality.structure), docs) == [naive_structure(v) for v in values]
    assert column(on_json(quality.consistency), docs) == [naive_consistency(v) for v in values]
    want = [naive_depth(v) if isinstance(v, dict) else None for v in values]
    assert column(on_json(jsontext.depth), docs) == want


def test_deep_documents_are_walked_to_the_end(column):
    deep = '{"k":' * 40 + '{"x":""}' + "}" * 40
    assert column(on_json(jsontext.depth), [deep]) == [41]
    assert column(on_json(quality.completeness), [deep]) == [100 - 100 // 41]
    flat = column(on_json(jsontext.flat_map), [deep])[0]
    assert flat == {".".join(["k"] * 40 + ["x"]): ""}


def test_flatten_and_largest_array(column):
    got = column(on_json(jsontext.flat_map), [fx.NESTED])[0]
    assert got["meta.page"] == "1" and got["meta.empty"] == "" and got["data.org"] == "X"
    assert got["data.tags"] == '["p","q","r"]'
    largest = column(on_json(jsontext.largest_array), [fx.NESTED, '{"b":[{"x":1}],"a":[{"y":1}]}', '{"a":[1]}'])
    assert [(r["n"], r["path"]) for r in largest] == [(2, "data.units"), (1, "a"), (0, "")]


def test_records(column):
    got = column(on_json(exports.record_maps), ['[{"a":{"b":1},"c":[1]},null]', fx.NESTED, '{"z":1,"a":null}', "5"])
    assert got[0] == [{"a.b": "1", "c": "[1]"}, {}]
    assert got[1] == [{"name": "A", "head.id": "1"}, {"name": "B", "head": ""}]
    assert got[2] == [{"field": "a", "value": ""}, {"field": "z", "value": "1"}]
    assert got[3] == []


def test_quality_states(spark):
    rows = [
        (1, "n 100 200", "", 0, "-", "pending"),
        (2, "n 100 200", "{bad", 25, "F", "scored"),
        (3, "id 100 amt 200", '{"id": 100 , "amt": 200 }', None, None, "scored"),
        (4, "", "[]", None, None, "scored"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, raw string, s string")
    got = {r["id"]: r["quality"] for r in quality.with_quality(df, "raw", "s").collect()}
    for i, _, _, score, grade, status in rows:
        assert got[i]["status"] == status
        if score is not None:
            assert (got[i]["score"], got[i]["grade"]) == (score, grade)
    assert got[1]["suggestions"] == ["Parse the document in Explorer to get a quality score"]
    assert tuple(got[2]["breakdown"]) == (25, 25, 25, 25)
    # completeness 100, one naming style 100, both numbers found 100, flat 60
    assert tuple(got[3]["breakdown"]) == (100, 100, 100, 60)
    assert got[3]["score"] == (3000 + 2500 + 2000 + 1500) // 100 and got[3]["grade"] == "A"
    assert got[3]["suggestions"] == ["Output structure is flat — consider nested grouping"]
    assert tuple(got[4]["breakdown"]) == (50, 60, 60, 30)


def test_leaf_mode_reads_compact_json(spark):
    df = spark.createDataFrame([("order 123 costs 456", '{"order":123,"costs":456}')], "raw string, s string")
    text = quality.with_quality(df, "raw", "s").first()["quality"]["breakdown"]["validity"]
    leaf = quality.with_quality(df, "raw", "s", mode="leaf").first()["quality"]["breakdown"]["validity"]
    assert (text, leaf) == (0, 100)


def test_exports(spark):
    df = spark.createDataFrame(
        [(1, '[{"b":"x|y","a":"1,2"},{"b":"q"}]'), (2, "[]"), (3, "nope")], "id int, s string"
    )
    get = lambda kind: {
        r["doc_id"]: r["content"] for r in exports.documents_as(df, "id", "s", kind, "none").collect()
    }
    assert get("csv") == {1: 'a,b\n"1,2",x|y\n,q', 2: "none", 3: "none"}
    assert get("tsv")[1] == "a\tb\n1,2\tx|y\n\tq"
    assert get("markdown")[1] == "| a | b |\n| --- | --- |\n| 1,2 | x\\|y |\n|  | q |"
    assert get("json")[3] == "nope" and json.loads(get("json")[1]) == [{"a": "1,2", "b": "x|y"}, {"b": "q"}]
    wide = exports.to_columns(exports.rows(df, "id", "s"))
    assert wide.columns == ["doc_id", "row", "a", "b"]


def test_null_structured_text_is_pending(spark):
    from quillgrid.operators.quality import with_quality

    df = spark.createDataFrame([("a b", None), (None, '{"a": 1}')], "raw string, s string")
    got = [r.quality for r in with_quality(df, "raw", "s").collect()]
    assert (got[0].score, got[0].status) == (0, "pending") and got[1].status == "scored"


def test_flat_objects_are_not_walked_for_their_depth(spark):
    # Taking the depth writes the value out as text and goes over it several times; objects without objects inside do not need it.
    text = F.concat(F.lit('{"a":1,"b":"'), F.repeat(F.lit(r"{word} \"said\" "), 5000), F.lit('","c":null}'))
    docs = spark.range(0, 400, 1, 4).select(jsontext.strict(text).alias("v"))
    assert docs.limit(1).select(F.map_keys(jsontext.flat_map(F.col("v"))).alias("k")).first()["k"] == ["a", "b", "c"]

    def seconds(value):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            docs.select(F.length(value)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    plain = seconds(jsontext.as_object(F.col("v"))["b"].cast("string"))
    assert seconds(jsontext.flat_map(F.col("v"))["b"]) < 2.5 * plain


def test_texts_that_could_write_the_end_mark_are_judged_alike(column):
    cases = {
        '"quillgridEnd"': True, '[1,"quillgridEnd"]': True, '1,"quillgridEnd"],[2': False, r'1,"quillgridEnd"],[2': False,
        '1],[2': False, '1},{"v":2': False, "1,2": False, "1 2": False, r'"é"': True, r'{"a":"\\u"}': True, "1,": False, "": False,
    }
    assert column(lambda c: jsontext.strict(c).isNotNull(), list(cases)) == list(cases.values())


def test_levels_beyond_those_opened_at_once(column):
    docs = ['{"a":{"b":{"c":{"d":{"e":1}},"x":{}},"":2},"l":[{"y":{}}]}', '{"a":{"b":{}}}', '{"":{"":{"":{"k":1}}}}', "{}", "[1]", '{"a":[]}']
    want = [{"a.b.c.d.e": "1", "a.": "2", "l": '[{"y":{}}]'}, {}, {"k": "1"}, {}, {}, {"a": "[]"}]
    assert column(on_json(jsontext.flat_map), docs) == want
