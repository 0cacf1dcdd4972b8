"""Queries over parsers and normalisation: text made from rows, parsed back, checked against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import normalise
from quillgrid.functions.core import trim_ws, unfold
from quillgrid.operators import parsers
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query

from quillgrid.sources.files import csv_rows as read_csv_rows
from quillgrid.sources.files import table

# --- logs -------------------------------------------------------------------------------------


def _entries(spark, sf):
    lines = D.log_lines(spark, sf).select("event_id", "line")
    return parsers.parse_log(lines, "line")


_MS = "(CAST(floor(date_part('microsecond', ts) / 1000) AS BIGINT) % 1000)"
_STAMP = f"strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST({_MS} AS VARCHAR), 3, '0')"


@query(
    "log_parse",
    f"""SELECT event_id, {_STAMP} AS at, {D.EVENT_LEVEL} AS level, 'POST' AS method, {D.EVENT_PATH} AS path,
  CAST({D.EVENT_STATUS} AS INT) AS status, user_id % 900 AS duration_ms, 'usr_' || user_id AS user_id,
  CASE WHEN event_type = 'error' THEN 'card: declined' END AS error, CAST(event_id % 7 AS VARCHAR) AS n FROM events""",
)
def log_parse(spark, sf):
    return _entries(spark, sf).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "level", "method", "path", "status",
        "duration_ms", "user_id", "error", F.try_element_at("fields", F.lit("count")).alias("n"),
    )


@query(
    "log_summary",
    f"""SELECT event_id % 20 AS day, count(*) AS total_entries, count(CASE WHEN {D.EVENT_LEVEL} = 'INFO' THEN 1 END) AS info, count(CASE WHEN event_type = 'signup' THEN 1 END) AS warn,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS error, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 END) AS payment_failures, {_STAMP.replace('ts', 'min(ts)')} AS first_at,
  count(DISTINCT {D.EVENT_PATH}) AS unique_endpoints, CAST(round(count(CASE WHEN event_type = 'error' THEN 1 END) * 100 / count(*)) AS INT) AS error_percent
FROM events GROUP BY 1""",
)
def log_summary(spark, sf):
    entries = _entries(spark, sf).withColumn("day", F.col("event_id") % 20)
    out = parsers.log_summary(entries, "day")
    return out.withColumn("first_at", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSS")).drop(
        "first_ts", "last_ts", "span_seconds"
    )


@query(
    "log_levels",
    f"SELECT event_id % 20 AS day, {D.EVENT_LEVEL} AS level, count(*) AS entries FROM events GROUP BY 1, 2",
)
def log_levels(spark, sf):
    return parsers.log_levels(_entries(spark, sf).withColumn("day", F.col("event_id") % 20), "day")


@query(
    "log_endpoints",
    f"""SELECT event_id % 20 AS day, 'POST' AS method, {D.EVENT_PATH} AS path, count(*) AS requests,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1, 3""",
)
def log_endpoints(spark, sf):
    return parsers.log_endpoints(_entries(spark, sf).withColumn("day", F.col("event_id") % 20), "day")


@query(
    "events_summary",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(DISTINCT user_id) AS users,
  round(count(CASE WHEN event_type = 'error' THEN 1 END) * 100.0 / count(*), 4) AS error_percent, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS span_seconds
FROM (SELECT date_trunc('second', ts) AS ts, event_type, user_id FROM events) GROUP BY 1""",
)
def events_summary(spark, sf):
    second = F.date_trunc("second", F.col("ts"))
    rows = table(spark, sf, "events").select(second.alias("ts"), "event_type", "user_id")
    errors = F.count_if(F.col("event_type") == "error")
    out = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), errors.alias("errors"), F.count_distinct("user_id").alias("users"),
        F.min("ts").alias("a"), F.max("ts").alias("b"),
    )
    return out.select(
        "day", "n", "errors", "users", F.round(F.col("errors") * 100.0 / F.col("n"), 4).alias("error_percent"),
        F.timestamp_diff("SECOND", F.col("a"), F.col("b")).alias("span_seconds"),
    )


_STATE = "CASE event_type WHEN 'error' THEN 'OPEN' WHEN 'purchase' THEN 'CLOSED' END"


@query(
    "log_transitions",
    f"""WITH m AS (SELECT user_id, ts, {_STATE} AS state FROM events), s AS (SELECT * FROM m WHERE state IS NOT NULL),
l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, state) AS before FROM s)
SELECT user_id, state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM l WHERE before IS NULL OR before <> state""",
)
def log_transitions(spark, sf):
    changes = parsers.transitions(table(spark, sf, "events"), "user_id", "ts", F.expr(_STATE))
    return changes.select(
        F.col("group").alias("user_id"), "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")
    )


# --- key-value blocks, markup, fences --------------------------------------------------------------


@query(
    "kv_parse",
    """SELECT c_custkey AS doc_id, 0 AS block, 'Name=' || c_name || ';Nation Key=' || c_nationkey || ';Segment=' || c_mktsegment AS pairs, 'free text here' AS body FROM customer
UNION ALL SELECT c_custkey, 1, 'Customer=' || c_custkey || ';Status=open', '' FROM customer""",
)
def kv_parse(spark, sf):
    docs = table(spark, sf, "customer").select("c_custkey", F.expr(D.KV_TEXT).alias("text"))
    blocks = parsers.kv_blocks(docs, "c_custkey", "text")
    entries = F.transform(F.array_sort(F.map_entries("pairs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return blocks.select("doc_id", "block", F.array_join(entries, ";").alias("pairs"), "body")


_XML = """'<?xml version="1.0"?><list><row id="' || CAST(p_partkey AS STRING) || '"><name>' || p_name || '</name><size>' || CAST(p_size AS STRING) || '</size></row><row id="y"><name>' || p_type || '</name></row><row id="x"><name>' || p_brand || '</name><size>0</size></row></list>'"""


@query(
    "xml_records",
    """SELECT p_partkey AS doc_id, 0 AS record, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part
UNION ALL SELECT p_partkey, 1, 'y', p_type, NULL FROM part UNION ALL SELECT p_partkey, 2, 'x', p_brand, '0' FROM part""",
)
def xml_records(spark, sf):
    docs = table(spark, sf, "part").select("p_partkey", F.expr(_XML).alias("text"))
    return parsers.xml_records(docs, "p_partkey", "text", "/list/row", ["@id", "name", "size"])


@query(
    "markdown_rows",
    """SELECT o_orderkey AS doc_id, 0 AS "table", 0 AS row, 'key,status,note' AS headers, o_orderkey || ',' || o_orderstatus || ',a|b' AS cells FROM orders
UNION ALL SELECT o_orderkey, 0, 1, 'key,status,note', o_custkey || ',' || o_orderpriority || ',' FROM orders
UNION ALL SELECT o_orderkey, 1, 0, 'day', CAST(o_custkey AS VARCHAR) FROM orders""",
)
def markdown_rows(spark, sf):
    docs = D.orders(spark, sf).select("o_orderkey", F.expr(D.MARKDOWN_TABLE).alias("text"))
    return parsers.markdown_rows(docs, "o_orderkey", "text").select(
        "doc_id", "table", "row", F.array_join("headers", ",").alias("headers"), F.array_join("cells", ",").alias("cells")
    )


_FENCED = """text || chr(10) || '```chart' || chr(10) || '{"type":"bar","n":' || CAST(turn AS STRING) || '}' || chr(10) || '```' || chr(10) || role || chr(10) || '```' || chr(10) || 'code ' || role || chr(10) || '```' || chr(10) || '```chart{"n":' || CAST(turn AS STRING) || '}```'"""


@query(
    "fenced_blocks",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, replace({_FENCED}, '```chart{{', '```chart' || chr(10) || '{{') AS text FROM conversations),
b AS (SELECT doc_id, regexp_extract_all(text, '```(\\w*)\\n([\\s\\S]*?)```', 1) AS ls, regexp_extract_all(text, '```(\\w*)\\n([\\s\\S]*?)```', 2) AS bs FROM t)
SELECT doc_id, unnest(range(len(ls))) AS block, unnest(ls) AS lang, unnest(bs) AS body,
  unnest(list_transform(list_zip(ls, bs), lambda z: z[1] = 'chart' AND json_valid(z[2]))) AS is_chart FROM b""",
)
def fenced_blocks(spark, sf):
    docs = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr(_FENCED).alias("text")
    )
    return parsers.fenced_blocks(docs, "doc_id", "text")


# --- entities ------------------------------------------------------------------------------------

_ENTITY_DOCS = f"""SELECT 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT 'o' || o_orderkey, {D.ORDER_RAW} || ' ref INV-2024-' || o_orderkey FROM orders"""
_ENTITIES = f"ed AS ({_ENTITY_DOCS}), mentions AS (" + " UNION ALL ".join(
    "SELECT doc_id, '{}' AS kind, unnest(regexp_extract_all(text, '{}')) AS value FROM ed".format(kind, pattern.replace("'", "''"))
    for kind, pattern in parsers.ENTITY_PATTERNS.items()
) + "), found AS (SELECT doc_id, kind, value, count(*) AS n FROM mentions GROUP BY ALL)"


def _found(spark, sf):
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string")).alias("doc_id")
    docs = (
        D.documents(spark, sf).select(key("d", "doc_id"), "text")
        .unionByName(D.pages(spark, sf).select(key("p", "page_id"), F.col("html").alias("text")))
        .unionByName(
            D.orders(spark, sf).select(
                key("o", "o_orderkey"),
                F.expr(D.ORDER_RAW + " || ' ref INV-2024-' || CAST(o_orderkey AS STRING)").alias("text"),
            )
        )
    )
    return parsers.entities(docs, "doc_id", "text")


@query("entities", f"WITH {_ENTITIES} SELECT doc_id, kind, value, n FROM found")
def entities(spark, sf):
    return _found(spark, sf).drop("opens_kind")


@query(
    "entity_counts",
    f"WITH {_ENTITIES} SELECT kind, CAST(sum(n) AS BIGINT) AS mentions, count(DISTINCT value) AS distinct_values, count(DISTINCT doc_id) AS documents FROM found GROUP BY kind",
)
def entity_counts(spark, sf):
    return parsers.entity_counts(_found(spark, sf))


# --- invoices ------------------------------------------------------------------------------------


def _money(cents: str) -> str:
    return f"CAST(CAST(floor(({cents}) / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(({cents}) % 100 AS STRING), 2, '0')"


_QTY, _UNIT = "(o_orderkey % 50 + 1)", "(o_custkey % 900 + 100)"
_SUB = f"({_QTY} * {_UNIT} + 2550 + (CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END))"
_TAX = "(o_custkey % 40 + 1)"
_INVOICE = f"""'INVOICE #INV-' || CAST(o_orderkey AS STRING) || chr(10) || chr(10) || 'From: Seller ' || CAST(o_orderkey % 10 AS STRING) || ' Ltd' || chr(10)
|| '      1 Main Street' || chr(10) || '      Tax ID: 12-' || CAST(o_orderkey AS STRING) || chr(10) || chr(10)
|| 'To:   Buyer ' || CAST(o_custkey AS STRING) || chr(10) || '      2 Side Street' || chr(10) || '      Attn: Desk' || chr(10) || chr(10)
|| 'Date: March ' || CAST(o_orderkey % 28 + 1 AS STRING) || ', 2024' || chr(10) || 'Due:  2024-04-15' || chr(10) || 'PO#:  PO-' || CAST(o_custkey AS STRING) || chr(10) || chr(10)
|| 'Description              Qty   Unit Price   Amount' || chr(10)
|| 'Small Server (s1)        ' || CAST({_QTY} AS STRING) || ' hrs   $' || {_money(_UNIT)} || '   $' || {_money(_QTY + ' * ' + _UNIT)} || chr(10)
|| 'Phone Support            1 mo   $25.50   $25.50' || chr(10) || 'Certificate              2       $0.00       FREE' || chr(10)
|| '               Subtotal:       $' || {_money(_SUB)} || chr(10) || '               Tax (8.5%):     $' || {_money(_TAX)} || chr(10)
|| '               TOTAL:          $' || {_money(_SUB + ' + ' + _TAX)} || chr(10) || chr(10)
|| 'Payment Terms: Net 30' || chr(10) || 'Wire to: Main Bank, Acct# 44' || CAST(o_custkey AS STRING) || ', Routing# 021'"""


@query(
    "invoice_parse",
    f"""SELECT o_orderkey, 'INV-' || o_orderkey AS number, '2024-03-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS day, 'PO-' || o_custkey AS po,
  'Seller ' || (o_orderkey % 10) || ' Ltd' AS seller, '12-' || o_orderkey AS tax_id, 'Buyer ' || o_custkey AS buyer, 'Desk' AS attention, 3 AS n_items,
  round(({_QTY} * {_UNIT} + 2550) / 100, 2) AS items_sum, round({_SUB} / 100, 2) AS subtotal, round({_TAX} / 100, 2) AS tax,
  round(({_SUB} + {_TAX}) / 100, 2) AS total, CAST(0.085 AS DOUBLE) AS tax_rate, '44' || o_custkey AS account, o_orderkey % 7 <> 0 AS reconciles FROM orders""",
)
def invoice_parse(spark, sf):
    docs = D.orders(spark, sf).select("o_orderkey", parsers.invoice(F.expr(_INVOICE)).alias("i"))
    return docs.select(
        "o_orderkey", "i.invoice.number", F.col("i.invoice.date").cast("string").alias("day"),
        F.col("i.invoice.purchase_order").alias("po"), F.col("i.sender.company").alias("seller"), "i.sender.tax_id",
        F.col("i.recipient.company").alias("buyer"), "i.recipient.attention", F.size("i.line_items").alias("n_items"),
        "i.items_sum", "i.totals.subtotal", "i.totals.tax", "i.totals.total", "i.totals.tax_rate",
        F.col("i.payment.account_number").alias("account"), "i.reconciles",
    )


@query(
    "order_reconcile",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 6))) AS s FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey, coalesce(n, 0) AS n_lines, round(coalesce(s, 0), 2) AS t, CAST(o_totalprice AS DECIMAL(18, 2)) AS p FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, n_lines, CAST(t AS DOUBLE) AS lines_total, CAST(p AS DOUBLE) AS stated, t = p AS reconciles FROM b""",
)
def order_reconcile(spark, sf):
    """Whether an order's lines add up to its stated total, in exact decimals."""
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount.cast("decimal(18,6)")).alias("s")
    )
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")
    total = F.round(F.coalesce("s", F.lit(0).cast("decimal(18,6)")), 2)
    stated = F.col("o_totalprice").cast("decimal(18,2)")
    return both.select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), total.cast("double").alias("lines_total"),
        stated.cast("double").alias("stated"), (total == stated).alias("reconciles"),
    )


# --- normalisation --------------------------------------------------------------------------------

ALIASES = {"LDV": "Lower Dale", "HMW": "Hemswell"}
_S = "(CAST(floor(abs(c_acctbal)) AS BIGINT) + 1000)"
_PEOPLE = {
    "name": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END",
    "age": "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'NOT_AVAILABLE' ELSE CAST(20 + c_custkey % 40 AS STRING) END",
    "city": "CASE c_custkey % 4 WHEN 0 THEN 'LDV' WHEN 1 THEN 'HMW' WHEN 2 THEN 'Corby' ELSE ' Lower Dale ' END",
    "salary": f"""CASE c_custkey % 5 WHEN 0 THEN '$' || CAST(CAST(floor({_S} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({_S} % 1000 AS STRING), 3, '0')
      WHEN 1 THEN CAST({_S} AS STRING) WHEN 2 THEN '$' || CAST({_S} AS STRING) WHEN 3 THEN CAST({_S} AS STRING) || '.00' ELSE 'a fair sum' END""",
    "email": "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'u' || CAST(c_custkey AS STRING) || '@mill' ELSE 'u' || CAST(c_custkey AS STRING) || '@mill.com' END",
}
_DAY_FORMS = ("MM/dd/yyyy", "yyyy-MM-dd", "MMMM d yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "MMM yyyy", "MM-yyyy")
_TAGS = ("MM/DD/YYYY", "YYYY-MM-DD", "Month D YYYY", "DD-Mon-YYYY", "YYYY/MM/DD", "Mon YYYY")
_DAY_SQL = "(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT))"


def _people(spark, sf):
    """Messy person records, one per customer, in the forms a spreadsheet would hold."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    start = F.lit("")
    for i, form in enumerate(_DAY_FORMS):
        start = F.when(F.col("c_custkey") % 8 == i, F.date_format(day, form)).otherwise(start)
    return table(spark, sf, "customer").select(
        "c_custkey", *[F.expr(e).alias(n) for n, e in _PEOPLE.items()], start.alias("start_date")
    )


_CLEAN_SQL = f"""SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 7 > 1 THEN 20 + c_custkey % 40 END AS age,
  ['Lower Dale', 'Hemswell', 'Corby', 'Lower Dale'][c_custkey % 4 + 1] AS city, CASE WHEN c_custkey % 5 < 4 THEN CAST({_S} AS DOUBLE) END AS salary,
  CASE WHEN c_custkey % 8 = 5 THEN strftime(date_trunc('month', {_DAY_SQL}), '%Y-%m-%d') WHEN c_custkey % 8 < 6 THEN strftime({_DAY_SQL}, '%Y-%m-%d') END AS start_date,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'u' || c_custkey || '@mill' ELSE 'u' || c_custkey || '@mill.com' END AS email,
  array_to_string(list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'missing name' END,
    CASE c_custkey % 7 WHEN 0 THEN 'missing age' WHEN 1 THEN 'age ''NOT_AVAILABLE''' END,
    CASE WHEN c_custkey % 5 = 4 THEN 'salary ''a fair sum'' not numeric' END,
    CASE WHEN c_custkey % 8 = 6 THEN 'date ''' || strftime({_DAY_SQL}, '%m-%Y') || ''' ambiguous' END,
    CASE c_custkey % 6 WHEN 0 THEN 'missing email' WHEN 1 THEN 'incomplete email domain' END], lambda x: x IS NOT NULL), '; ') AS issues
FROM customer"""


@query("row_issues", _CLEAN_SQL)
def row_issues(spark, sf):
    clean = parsers.normalise_people(_people(spark, sf), ALIASES)
    return clean.select(
        "c_custkey", "name", "age", "city", "salary", F.col("start_date").cast("string").alias("start_date"), "email",
        F.array_join("issues", "; ").alias("issues"),
    )


@query(
    "normalise_summary",
    f"""WITH c AS ({_CLEAN_SQL}) SELECT count(*) AS total_rows, count(CASE WHEN issues <> '' THEN 1 END) AS issue_rows, count(CASE WHEN name IS NULL THEN 1 END) AS missing_name,
  count(CASE WHEN age IS NULL THEN 1 END) AS missing_age, count(CASE WHEN city IS NULL THEN 1 END) AS missing_city, count(CASE WHEN salary IS NULL THEN 1 END) AS missing_salary,
  count(CASE WHEN start_date IS NULL THEN 1 END) AS missing_start_date, count(CASE WHEN email IS NULL THEN 1 END) AS missing_email, '{'|'.join(sorted(_TAGS))}' AS date_forms FROM c""",
)
def normalise_summary(spark, sf):
    out = parsers.people_summary(parsers.normalise_people(_people(spark, sf), ALIASES))
    return out.withColumn("date_forms", F.array_join("date_forms", "|"))


@query(
    "normalise_number",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN CAST({_S} AS DOUBLE) END AS value,
  CASE c_custkey % 5 WHEN 0 THEN '$' || repeat('X', length(CAST({_S} AS VARCHAR)) - 3) || ',XXX' WHEN 1 THEN repeat('X', length(CAST({_S} AS VARCHAR)))
    WHEN 2 THEN '$' || repeat('X', length(CAST({_S} AS VARCHAR))) WHEN 3 THEN repeat('X', length(CAST({_S} AS VARCHAR))) || '.XX' ELSE 'text (''a fair sum'')' END AS form FROM customer""",
)
def normalise_number(spark, sf):
    return _people(spark, sf).select(
        "c_custkey", normalise.number(F.col("salary")).alias("value"), normalise.number_form(F.col("salary")).alias("form")
    )


@query(
    "normalise_date",
    """SELECT l_orderkey, l_linenumber, l_partkey, unnest([%s]) AS form, unnest([%s, strftime(date_trunc('month', l_shipdate), '%%Y-%%m-%%d')]) AS iso FROM lineitem"""
    % (", ".join(f"'{t}'" for t in _TAGS), ", ".join(["strftime(l_shipdate, '%Y-%m-%d')"] * 5)),
)
def normalise_date(spark, sf):
    """Every ship date written in all forms and read back."""
    lines = table(spark, sf, "lineitem")
    written = F.array(*[F.date_format("l_shipdate", f) for f in _DAY_FORMS[:6]])
    texts = unfold(lines, ["l_orderkey", "l_linenumber", "l_partkey"], written, "_i", "text")
    return texts.select(
        "l_orderkey", "l_linenumber", "l_partkey", normalise.date_form(F.col("text")).alias("form"),
        normalise.date(F.col("text")).cast("string").alias("iso"),
    )


@query(
    "alias_map",
    "SELECT city, count(*) AS n FROM (SELECT ['Lower Dale', 'Hemswell', 'Corby', 'Lower Dale'][c_custkey % 4 + 1] AS city FROM customer) GROUP BY city",
)
def alias_map(spark, sf):
    city = normalise.alias(trim_ws(F.col("city")), ALIASES)
    return _people(spark, sf).groupBy(city.alias("city")).agg(F.count(F.lit(1)).alias("n"))


# --- delimited text -----------------------------------------------------------------------------

_REPAIR_TEXT = f"""'key,price,status' || chr(10) || CAST(c_custkey AS STRING) || ',$' || CAST(CAST(floor({_S} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({_S} % 1000 AS STRING), 3, '0') || ',ok' || chr(10) || CAST(c_custkey AS STRING) || ',$5,ok' || chr(10) || '7,"$1,5",ok'"""


@query(
    "csv_repair",
    f"""SELECT c_custkey AS doc_id, 1 AS row, c_custkey || '|$' || {_S} || '|ok' AS fields, FALSE AS ragged FROM customer
UNION ALL SELECT c_custkey, 2, c_custkey || '|$5|ok', FALSE FROM customer UNION ALL SELECT c_custkey, 3, '7|$1,5|ok', FALSE FROM customer
UNION ALL SELECT c_custkey, 0, 'key|price|status', FALSE FROM customer""",
)
def csv_repair(spark, sf):
    docs = table(spark, sf, "customer").select("c_custkey", F.expr(_REPAIR_TEXT).alias("text"))
    return read_csv_rows(docs, "c_custkey", "text").select(
        "doc_id", "row", F.array_join("fields", "|").alias("fields"), "ragged"
    )


@query(
    "csv_rows",
    f"""WITH {D.CSV_CELLS_SQL} SELECT doc_id, n AS row, array_to_string(r, '|') AS fields, len(r) AS n_fields FROM csv_records
UNION ALL SELECT doc_id, 0, 'line|chars|first|mail|day|price', 6 FROM documents""",
)
def csv_rows(spark, sf):
    return read_csv_rows(D.csv_docs(spark, sf), "doc_id", "text").select(
        "doc_id", "row", F.array_join("fields", "|").alias("fields"), "n_fields"
    )
