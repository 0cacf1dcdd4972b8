import datetime as dt
import re

from pyspark.sql import functions as F

from quillgrid.functions import csvtext, normalise
from quillgrid.operators import parsers
from tests import fixtures as fx


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id bigint, text string")


def test_dates_and_numbers(column):
    d = dt.date
    cases = {
        "01/15/2023": d(2023, 1, 15), "2023-03-22": d(2023, 3, 22), "March 1 2022": d(2022, 3, 1),
        "March 15, 2024": d(2024, 3, 15), "Mar 3 2024": d(2024, 3, 3), "15-Jan-2024": d(2024, 1, 15),
        "2023/07/10": d(2023, 7, 10), "Aug 2023": d(2023, 8, 1), "01-2023": None, "13/45/2023": None, "x": None,
    }
    assert dict(zip(cases, column(normalise.date, list(cases)))) == cases
    numbers = {"$85,000": 85000.0, "95000.00": 95000.0, "ninety": None, "": None, "1d": None, "-3": -3.0}
    assert dict(zip(numbers, column(normalise.number, list(numbers)))) == numbers


def test_camel_case(column):
    cases = {"Start Date": "startDate", "user_id": "userId", "NAME": "name", "startDate": "startDate", "p50 ms": "p50Ms"}
    assert dict(zip(cases, column(normalise.camel_case, list(cases)))) == cases
    assert {k: normalise.camel_name(k) for k in cases} == cases


def test_messy_people(spark):
    rows = one(spark, fx.PEOPLE).select(F.explode(F.slice(csvtext.records(F.col("text")), 2, 100)).alias("f"))
    names = ("email", "start_date", "city", "name", "salary", "age")
    df = rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    clean = parsers.normalise_people(df, fx.ALIASES)
    got = {r["email"] or r["name"]: r for r in clean.collect()}
    assert got["nora@harbor.test"]["issues"] == [] and got["nora@harbor.test"]["age"] == 52
    assert got["pim@harbor.test"]["issues"] == ["missing age"] and got["pim@harbor.test"]["city"] == "Turku"
    assert got["pim@harbor.test"]["start_date"] == dt.date(2020, 2, 1) and got["pim@harbor.test"]["salary"] == 48150.75
    assert got["lea@harbor"]["issues"] == ["incomplete email domain"] and got["lea@harbor"]["salary"] == 1050000.0
    assert got["Ari Salo"]["issues"] == ["missing email"] and got["Ari Salo"]["city"] == "Gent"
    assert "salary 'a lot' not numeric" in got["ruth@harbor.test"]["issues"]
    assert "date '13-2021' ambiguous" in got["ruth@harbor.test"]["issues"] and len(got["ruth@harbor.test"]["issues"]) == 3
    assert got["sol@harbor.test"]["issues"] == ["missing name"] and got["sol@harbor.test"]["salary"] == 43500.0
    assert got["sol@harbor.test"]["start_date"] == dt.date(2022, 9, 9)
    assert got["ivo@harbor.test"]["start_date"] is None and got["ivo@harbor.test"]["age"] == 61
    s = parsers.people_summary(clean).first()
    assert s["total_rows"] == 7
    assert (s["missing_name"], s["missing_age"], s["missing_email"], s["missing_salary"]) == (1, 2, 1, 1)
    assert s["missing_start_date"] == 2


def test_log(spark):
    lines = parsers.log_lines(one(spark, fx.LOG + "\nnot an entry"), "id", "text")
    entries = parsers.parse_log(lines, "line").orderBy("line_no").collect()
    assert [e["is_entry"] for e in entries] == [True] * 7 + [False]
    pay = entries[4]
    assert (pay["level"], pay["method"], pay["path"], pay["status"], pay["duration_ms"]) == (
        "ERROR", "POST", "/fees/payments", 502, 88,
    )
    assert (pay["error"], pay["user_id"], pay["amount"]) == ("bank: closed", "r2", 3.75)
    assert entries[0]["message"] == "disk nearly full" and entries[0]["fields"] == {"volume": "v3"}
    assert entries[0]["ts"] == dt.datetime(2031, 11, 20, 17, 30, 0, 500000)
    parsed = parsers.parse_log(lines, "line")
    s = parsers.log_summary(parsed, "doc_id").first()
    assert (s["total_entries"], s["info"], s["warn"], s["error"]) == (7, 3, 2, 2)
    assert (s["failed"], s["error_percent"], s["payment_failures"]) == (2, 29, 1)
    assert s["span_seconds"] == 239.5 and s["unique_endpoints"] == 3
    state = F.regexp_extract("message", "valve (shut|open)", 1)
    changes = parsers.transitions(parsed, "doc_id", "ts", F.nullif(state, F.lit(""))).orderBy("at").collect()
    assert [(c["state"], c["at"].strftime("%H:%M:%S")) for c in changes] == [("shut", "17:32:00"), ("open", "17:33:45")]


def test_transitions_across_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    states = ["A", "A", "B", "B", "B", "A", None, "A", "C"]
    rows = [("g", base + dt.timedelta(minutes=50 * i), s) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, s string")
    got = parsers.transitions(df, "g", "ts", F.col("s")).orderBy("at").collect()
    assert [r["state"] for r in got] == ["A", "B", "A", "C"]


def test_transitions_of_a_group_that_holds_all_rows(spark):
    """Its ranges are compared apart, and agree with one scan; the stored ranges hold about equal shares."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 500 == 0, F.lit("h")).otherwise(F.lit("g")).alias("g"),
        F.timestamp_seconds(F.col("id") % 3000).alias("ts"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int") + 1).alias("s"))
    got = sorted((r["group"], r["at"], r["state"]) for r in parsers.transitions(df, "g", "ts", F.col("s")).collect())
    want, last = [], {}
    for r in sorted((r for r in df.collect() if r["s"] is not None), key=lambda r: (r["g"], r["ts"], r["s"])):
        if last.get(r["g"]) != r["s"]:
            want.append((r["g"], r["ts"], r["s"]))
        last[r["g"]] = r["s"]
    assert got == want
    plan = parsers.transitions(df, "g", "ts", F.col("s"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in plan and all("part" in line for line in plan.splitlines() if "Window [lag(state" in line)


def test_key_value_blocks(spark):
    got = parsers.kv_blocks(one(spark, fx.TICKETS), "id", "text").orderBy("block").collect()
    assert [b["pairs"].get("Subject") for b in got] == ["Printer on fire", "New chair"]
    assert got[0]["pairs"]["Date"] == "2031-05-02 9:15 PM" and got[0]["pairs"]["Status"] == "Open"
    assert got[0]["body"] == "Smoke is coming out of tray two.\nPlease hurry."


def test_invoice(spark):
    r = one(spark, fx.INVOICE).select(parsers.invoice(F.col("text")).alias("i")).first()["i"]
    assert r["invoice"]["number"] == "INV-77" and r["invoice"]["date"] == dt.date(2030, 2, 11)
    assert r["invoice"]["due_date"] == dt.date(2030, 3, 1) and r["invoice"]["purchase_order"] == "B-77"
    assert r["sender"]["company"] == "Saltmarsh Printing" and r["sender"]["tax_id"] == "55-120"
    assert r["sender"]["address"] == "Mill Row 8, Lund, 22100"
    assert r["recipient"]["company"] == "Reed and Sons" and r["recipient"]["attention"] == "Edda Reed"
    assert [tuple(i) for i in r["line_items"]] == [
        ("Poster (large)", 40.0, None, 1.25, 50.0), ("Cloth Binding", 12.5, "m", 4.0, 50.0), ("Proof Sheet", 1.0, None, 0.0, 0.0),
    ]
    assert tuple(r["totals"]) == (100.0, 0.2, 20.0, 120.0) and r["items_sum"] == 100.0 and r["reconciles"]
    assert tuple(r["payment"]) == ("Skerry Savings", "5501", "8812")


def test_entities(spark):
    text = "Mail a@b.co or a@b.co, call 555-123-4567, pay $1,200.50 by 2024-01-02 for INV-22 at https://x.io/p?q=1"
    got = {(r["kind"], r["value"]): r["n"] for r in parsers.entities(one(spark, text), "id", "text").collect()}
    assert got == {
        ("email", "a@b.co"): 2, ("phone", "555-123-4567"): 1, ("amount", "$1,200.50"): 1,
        ("date", "2024-01-02"): 1, ("id", "INV-22"): 1, ("url", "https://x.io/p?q=1"): 1,
    }
    counts = parsers.entity_counts(parsers.entities(one(spark, text), "id", "text"))
    assert {r["kind"]: (r["mentions"], r["distinct_values"], r["documents"]) for r in counts.collect()}["email"] == (2, 1, 1)


def test_markup(spark):
    got = parsers.xml_records(one(spark, fx.XML), "id", "text", "/shop/item", ["@id", "name", "price"]).collect()
    assert [tuple(r)[2:] for r in got] == [("a1", "Cup", "4.5"), ("a2", "Pot", "12")]
    flat = parsers.flat_json(one(spark, fx.NESTED), "id", "text").collect()
    assert [r["field"] for r in flat] == sorted(r["field"] for r in flat) and len(flat) == 6
    table = "intro\n| a | b |\n| --- | :-: |\n| 1 | x\\|y |\n| 2 |  |\n"
    rows = parsers.markdown_rows(one(spark, table), "id", "text").collect()
    assert rows[0]["headers"] == ["a", "b"] and [r["cells"] for r in rows] == [["1", "x|y"], ["2", ""]]
    fenced = 'x\n```chart\n{"type":"bar"}\n```\ny\n```py\nprint(1)\n```\n```chart\nbad\n```'
    blocks = parsers.fenced_blocks(one(spark, fenced), "id", "text").collect()
    assert [(b["lang"], b["is_chart"]) for b in blocks] == [("chart", True), ("py", False), ("chart", False)]
    assert blocks[1]["body"] == "print(1)\n"


def test_markup_with_gaps(spark):
    text = "<!-- a --><l><r><n>A</n></r><r k='2'><n>B</n><p>9</p><o><m>x</m></o></r><r><p>1</p><p>2</p></r></l>"
    rows = parsers.xml_records(one(spark, text), "id", "text", "/l/r", ["n", "p", "@k", "o/m"]).orderBy("record").collect()
    assert [tuple(r)[2:] for r in rows] == [("A", None, None, None), ("B", "9", "2", "x"), (None, "1", None, None)]
    deep = "<a><b><c><v>1</v></c></b><b/><b><c><v>2</v></c><c><v>3</v></c></b></a>"
    assert [r["v"] for r in parsers.xml_records(one(spark, deep), "id", "text", "/a/b/c", ["v"]).orderBy("record").collect()] == ["1", "2", "3"]
    for bad in (None, "", "no xml", "<l><r>", "<other><r><n>A</n></r></other>"):
        df = spark.createDataFrame([(1, bad)], "id int, text string")
        assert parsers.xml_records(df, "id", "text", "/l/r", ["n"]).count() == 0, bad
    two = "| a |\n|---|\n| 1 |\n| 2 |\n\n| b | c |\n| --- | --- |\n| 3 | 4 |\ntext\n| d |\n"
    rows = parsers.markdown_rows(one(spark, two), "id", "text").orderBy("table", "row").collect()
    assert [(r["table"], r["row"], r["headers"], r["cells"]) for r in rows] == [
        (0, 0, ["a"], ["1"]), (0, 1, ["a"], ["2"]), (1, 0, ["b", "c"], ["3", "4"])]
    chart = parsers.fenced_blocks(one(spark, 'so ```chart{"n":1}``` it is'), "id", "text").first()
    assert (chart["lang"], chart["body"], chart["is_chart"]) == ("chart", '{"n":1}', True)


def test_log_stamps_and_levels(spark):
    text = "\n".join((
        "2031-03-15T08:23:14.123Z INFO GET /a 200 5ms", "2031-03-15T10:23:15+02:00 DEBUG GET /a 503 5ms",
        "[2031-03-15T03:23:16-0500] FATAL down", "2031/03/15 08:23:17 INFO GET /b 404"))
    parsed = parsers.parse_log(parsers.log_lines(one(spark, text), "id", "text"), "line")
    stamps = [r["ts"] for r in parsed.orderBy("line_no").collect()]
    assert [s.strftime("%H:%M:%S") for s in stamps] == ["08:23:14", "08:23:15", "08:23:16", "08:23:17"]
    assert stamps[0].microsecond == 123000
    levels = {r["level"]: r["entries"] for r in parsers.log_levels(parsed, "doc_id").collect()}
    assert levels == {"INFO": 2, "DEBUG": 1, "FATAL": 1}
    ends = {r["path"]: (r["requests"], r["failed"]) for r in parsers.log_endpoints(parsed, "doc_id").collect()}
    assert ends == {"/a": (2, 1), "/b": (1, 1)}


def test_addresses_in_long_runs_take_linear_time(spark):
    import random
    import time

    draw = random.Random(5)
    texts = ["".join(draw.choice("aB1._%-@@. ,;é") for _ in range(60)) for _ in range(3000)] + ["a@b.com_x@c.org", "x@y.co@z.de", "a@b.c@d.ee", "q" * 300_000]
    pattern = parsers.ENTITY_PATTERNS["email"]
    from collections import Counter

    # The long run has no address, so that only Python's matcher is spared it.
    want = {(i, v): n for i, t in enumerate(texts[:-1]) for v, n in Counter(re.findall(pattern, t)).items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = time.time()
    got = {(r["doc_id"], r["value"]): r["n"] for r in parsers.entities(df, "doc_id", "text", {"email": pattern}).collect()}
    assert got == want and len(want) > 20
    assert time.time() - start < 20
