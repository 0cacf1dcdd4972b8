"""Indented JSON by column expressions, against the standard library where that keeps what is written."""

import json
import random

from quillgrid.functions import core, jsontext
from quillgrid.operators.exports import pretty_json
from pyspark.sql import functions as F


def test_numbers_keep_their_form(column):
    got = column(jsontext.pretty, ['{"b":1.50,"a":[1e3,-0.0,12345678901234567890123],"1":"1~"}', ' [ ] ', "{}", "7.10", '"x"', "null", "[true,[]]"])
    assert got == [
        '{\n  "1": "1~",\n  "a": [\n    1e3,\n    -0.0,\n    12345678901234567890123\n  ],\n  "b": 1.50\n}', "[]", "{}", "7.10", '"x"', "null",
        "[\n  true,\n  []\n]",
    ]


def test_texts_that_look_like_tokens(column):
    values = ["{}", "[1,2]", "5~", "~", "~5", 'a"b', "\\", "\\\"", "1", ":,", "\n\t", "€\U0001f600", "", '","k":"1~"']
    texts = [json.dumps({v: v, "list": [v, {v: [v]}]}, ensure_ascii=False) for v in values]
    assert column(jsontext.pretty, texts) == [json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False) for t in texts]


def test_invalid_texts_pass_through(column):
    bad = ["", "{", "{1:2}", "[01]", "[1 2]", "-", "[.5]", "[1.]", "null1", "{} {}", "NaN", None]
    assert column(pretty_json, bad) == bad
    assert column(jsontext.pretty, bad) == [None] * len(bad)


def test_random_values(column):
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randrange(7 if depth < 5 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        if kind == 6:
            return {rnd.choice("abcdeé~!#") * rnd.randrange(1, 3): value(depth + 1) for _ in range(rnd.randrange(4))}
        return [rnd.randrange(-99, 99), rnd.random() * 1e9, None, rnd.random() < 0.5, "".join(rnd.choice('a"\\{}[],:~1 ') for _ in range(6))][kind]

    texts = [json.dumps(value(0), ensure_ascii=False) for _ in range(200)]
    assert column(jsontext.pretty, texts) == [json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False) for t in texts]


def test_long_and_deep_texts(column):
    wide = json.dumps([{"k": i, "t": '\\"' * 5} for i in range(20000)])
    deep = "[" * 300 + "]" * 300
    long = json.dumps({"t": '"' * 200000})
    assert column(jsontext.pretty, [wide, deep, long]) == [json.dumps(json.loads(t), indent=2) for t in (wide, deep, long)]


def test_running_sums(spark):
    lists = [[], [3], [1, -1, 1], list(range(50)), [1] * 1001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    got = [r[0] for r in df.orderBy("i").select(core.running_sums(F.col("v"))).collect()]
    assert got == [[sum(v[: k + 1]) for k in range(len(v))] for v in lists]
