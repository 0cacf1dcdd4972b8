"""Documents derived from the shared tables, and the SQL that derives the same ones.

The tables hold prose, web pages, orders and events. Delimited, JSON, log, key-value and Markdown
documents are derived from their rows, so every query grows with the tables. Expressions written
as text are valid in both Spark SQL and the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions.core import lines_of

from quillgrid.sources.files import table

WS = K.WHITE_SPACE


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# --- JSON documents: one per order, in ten shapes -------------------------------------------

_K = "CAST(o_orderkey AS STRING)"
_K1 = "CAST(o_orderkey + 1 AS STRING)"
_C = "CAST(o_custkey AS STRING)"
_T = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
ORDER_JSON = f"""CASE o_orderkey % 10
WHEN 0 THEN '[{{"id":' || {_K} || ',"cust":' || {_C} || ',"status":"' || o_orderstatus || '"}},{{"id":' || {_K1} || ',"cust":null,"status":""}}]'
WHEN 1 THEN '[{{"id":' || {_K} || ',"cust":' || {_C} || ',"note":"x"}},{{"id":' || {_K1} || ',"cust":' || {_C} || '}},{{"id":"none"}}]'
WHEN 2 THEN '{{"orderKey":' || {_K} || ',"custKey":' || {_C} || ',"order_status":"' || o_orderstatus || '","Note":""}}'
WHEN 3 THEN '{{"order":{{"key":' || {_K} || ',"priority":"' || o_orderpriority || '"}},"total":' || {_T} || ',"note":null}}'
WHEN 4 THEN '{{"order":{{"key":' || {_K} || ',"flags":["a","b"]}},"lines":[{{"n":1,"v":' || {_C} || '}},{{"n":2}}],"tags":["x","y"]}}'
WHEN 5 THEN '{{"order":' || {_K} || ',"broken":'
WHEN 6 THEN ''
WHEN 7 THEN '[ ' || {_K} || ' , ' || {_T} || ' ]'
WHEN 8 THEN CASE WHEN o_custkey % 2 = 0 THEN '{{}}' ELSE '[]' END
ELSE '{{ "id": ' || {_K} || ' , "total": ' || {_T} || ' , "mail": "c' || {_C} || '@example.com" , "paid": true }}'
END"""
ORDER_RAW = f"""'Order ' || {_K} || ' of c' || {_C} || '@example.com: total ' || {_T} || ', (' || o_orderpriority || ') due 2024-01-02'"""
ORDER_DOCS_SQL = f"""order_docs AS (
  SELECT o_orderkey AS doc_id, o_custkey AS cust, {ORDER_RAW} AS raw, {ORDER_JSON} AS structured FROM orders)"""


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, cust, raw, structured``: one JSON document per order."""
    return orders(spark, sf).selectExpr(
        "o_orderkey AS doc_id", "o_custkey AS cust", f"{ORDER_RAW} AS raw", f"{ORDER_JSON} AS structured"
    )


# --- delimited documents: one per document, a record per line ---------------------------------

CSV_HEADER = ("line", "chars", "first", "mail", "day", "price")


def csv_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text``: the lines of each document described as delimited records."""
    def record(line, i):
        n, size = i + 1, F.length(line).cast("string")
        text = n.cast("string")
        return F.concat_ws(
            ",", text, size, F.regexp_extract(line, "[A-Za-z]+", 0),
            F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("u"), text, F.lit("@example.com"))),
            F.when(n % 4 == 0, "N/A").otherwise(
                F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
            ),
            F.when(n % 2 == 0, F.concat(F.lit("$"), size, F.lit(".50"))).otherwise(size),
        )

    body = F.array_join(F.transform(lines_of(F.col("text")), record), "\n")
    return documents(spark, sf).select(
        "doc_id", F.concat(F.lit(",".join(CSV_HEADER) + "\n"), body).alias("text")
    )


CSV_CELLS_SQL = """csv_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
csv_records AS (
  SELECT doc_id, n, [CAST(n AS VARCHAR), CAST(length(l) AS VARCHAR), regexp_extract(l, '[A-Za-z]+'),
    CASE WHEN n % 3 = 0 THEN '' ELSE 'u' || n || '@example.com' END,
    CASE WHEN n % 4 = 0 THEN 'N/A' ELSE '2024-01-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') END,
    CASE WHEN n % 2 = 0 THEN '$' || length(l) || '.50' ELSE CAST(length(l) AS VARCHAR) END] AS r
  FROM csv_lines),
csv_cells AS (
  SELECT doc_id, n, unnest([0, 1, 2, 3, 4, 5]) AS position,
         unnest(['line', 'chars', 'first', 'mail', 'day', 'price']) AS name, unnest(r) AS value
  FROM csv_records)"""
CSV_TEXT_SQL = """csv_text AS (
  SELECT doc_id, 'line,chars,first,mail,day,price' || chr(10)
         || string_agg(array_to_string(r, ','), chr(10) ORDER BY n) AS text
  FROM csv_records GROUP BY doc_id)"""


def classify_sql(v: str) -> str:
    """The oracle's statement of value classification."""
    bare = f"replace(regexp_replace({v}, '^\\$?€?', ''), ',', '')"
    return f"""CASE WHEN regexp_matches({v}, '{K.EMAIL}') THEN 'email'
      WHEN regexp_matches({v}, '{K.URL}') THEN 'url'
      WHEN regexp_matches({v}, '{K.DATE}') THEN 'date'
      WHEN lower({v}) IN ('true', 'false') THEN 'boolean'
      WHEN regexp_matches({bare}, '{K.NUMBER}') THEN 'number' ELSE 'string' END"""


MISSING_SQL = "('', 'null', 'n/a', 'not_available')"

# --- log, key-value and Markdown documents --------------------------------------------------

EVENT_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"
EVENT_PATH = "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '/api/payments' ELSE '/api/' || event_type END"
EVENT_STATUS = "CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' ELSE '200' END"
EVENT_TAIL = f"""' ' || {EVENT_PATH} || ' ' || {EVENT_STATUS} || ' ' || CAST(user_id % 900 AS STRING) || 'ms user_id=usr_' || CAST(user_id AS STRING) || CASE WHEN event_type = 'error' THEN ' err="card: declined"' ELSE '' END || ' count=' || CAST(event_id % 7 AS STRING)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One log line per event: ``event_id, user_id, line``, with stamps in brackets, in UTC, or with an offset."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    stamp = (
        F.when(F.col("event_id") % 4 == 1, F.date_format("ts", iso + "'Z'"))
        .when(F.col("event_id") % 4 == 2, F.date_format(F.col("ts") + F.expr("INTERVAL '2' HOUR"), iso + "'+02:00'"))
        .otherwise(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("]")))
    )
    return events(spark, sf).select(
        "event_id", "user_id", "event_type", "ts",
        F.concat(
            stamp, F.lit(" "), F.expr(EVENT_LEVEL), F.lit(" POST"), F.expr(EVENT_TAIL)
        ).alias("line"),
    )


_MS = "lpad(CAST(CAST(floor(date_part('microsecond', ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
LOG_LINES_SQL = f"""log_lines AS (
  SELECT event_id, user_id, event_type, ts,
    CASE event_id % 4 WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || {_MS} || 'Z'
      WHEN 2 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.') || {_MS} || '+02:00'
      ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.') || {_MS} || ']' END
    || ' ' || {EVENT_LEVEL} || ' POST' || {EVENT_TAIL} AS line FROM events)"""

KV_TEXT = """'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'Nation Key: ' || CAST(c_nationkey AS STRING) || chr(10) || 'free text here' || chr(10) || '---' || chr(10) || 'Customer: ' || CAST(c_custkey AS STRING) || chr(10) || 'Status: open'"""
MARKDOWN_TEXT = """'# ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '## turn ' || CAST(turn AS STRING)"""
MARKDOWN_TABLE = """'Order ' || CAST(o_orderkey AS STRING) || chr(10) || '| key | status | note |' || chr(10) || '| --- | :-: | --- |' || chr(10) || '| ' || CAST(o_orderkey AS STRING) || ' | ' || o_orderstatus || ' | a\\\\|b |' || chr(10) || '| ' || CAST(o_custkey AS STRING) || ' | ' || o_orderpriority || ' |  |' || chr(10) || 'Next' || chr(10) || '| day |' || chr(10) || '|---|' || chr(10) || '| ' || CAST(o_custkey AS STRING) || ' |'"""
