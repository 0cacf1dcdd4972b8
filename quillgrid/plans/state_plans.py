"""Queries over relational state: listings, collections, updates, recency, tables, milestones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import normalise
from quillgrid.operators import collections as C
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.sources.files import table


@query("doc_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def doc_lookup(spark, sf):
    return C.lookup(table(spark, sf, "orders"), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("list_documents", "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY doc_id DESC")
def list_documents(spark, sf):
    return C.newest(table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars"], F.desc("doc_id"))


@query(
    "doc_listing",
    "SELECT '#' || o_orderkey || ': order-' || o_orderkey || '.txt (' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ')' AS line FROM orders",
)
def doc_listing(spark, sf):
    name = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    return table(spark, sf, "orders").select(C.listing_line(F.col("o_orderkey"), name, F.col("o_orderdate")).alias("line"))


@query(
    "doc_preview",
    f"""SELECT doc_id, CASE WHEN length(text) > {K.RAW_PREVIEW} THEN substr(text, 1, {K.RAW_PREVIEW}) || chr(10) || chr(10) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END AS raw,
  CASE WHEN length(text) > {K.DIGEST_RAW} THEN substr(text, 1, {K.DIGEST_RAW}) || chr(10) || '... [truncated]' ELSE text END AS short FROM documents""",
)
def doc_preview(spark, sf):
    return D.documents(spark, sf).select(
        "doc_id", C.raw_preview(F.col("text"), K.RAW_PREVIEW).alias("raw"), C.preview(F.col("text"), K.DIGEST_RAW).alias("short")
    )


@query(
    "collection_digest",
    f"""WITH d AS (SELECT source, doc_id, lang || '.txt' AS name, text, CASE WHEN doc_id % 3 = 0 THEN '{{"chars":' || n_chars || '}}' ELSE '' END AS s FROM documents)
SELECT source, doc_id, '=== Document #' || doc_id || ': ' || name || ' ===' || chr(10) || CASE
  WHEN s <> '' THEN 'Structured data:' || chr(10) || s || chr(10) || chr(10)
  WHEN text <> '' THEN 'Raw content:' || chr(10) || text || chr(10) || chr(10)
  ELSE '' END AS block FROM d""",
)
def collection_digest(spark, sf):
    docs = D.documents(spark, sf).select(
        "source", "doc_id", F.concat("lang", F.lit(".txt")).alias("name"), "text",
        F.expr("""CASE WHEN doc_id % 3 = 0 THEN '{"chars":' || CAST(n_chars AS STRING) || '}' ELSE '' END""").alias("s"),
    )
    return C.digest(docs, "doc_id", "name", "text", "s", keep=("source",))


_STATUS_DOCS = """SELECT doc_id, structured, CASE WHEN cust % 2 = 0 THEN 'schema' ELSE '' END AS schema_json, CASE WHEN cust % 3 = 0 THEN 'text' ELSE '' END AS summary"""


@query(
    "doc_status",
    f"""WITH {D.ORDER_DOCS_SQL}, d AS ({_STATUS_DOCS} FROM order_docs)
SELECT doc_id, CASE WHEN structured = '' THEN 'not parsed' WHEN schema_json = '' THEN 'no schema' WHEN summary = '' THEN 'no summary' ELSE 'complete' END AS status FROM d""",
)
def doc_status(spark, sf):
    docs = D.order_docs(spark, sf).selectExpr(
        "doc_id", "structured", "CASE WHEN cust % 2 = 0 THEN 'schema' ELSE '' END AS schema_json",
        "CASE WHEN cust % 3 = 0 THEN 'text' ELSE '' END AS summary",
    )
    return docs.select(
        "doc_id", C.presence(F.col("structured"), F.col("schema_json"), F.col("summary")).alias("status")
    )


@query(
    "docs_by_user",
    "SELECT c_custkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
def docs_by_user(spark, sf):
    users = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    docs = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return docs.join(users, "c_custkey")


def _memberships(spark, sf):
    """A document belongs to the collection of its source and to that of its language."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(F.array("source", "lang")).alias("collection_id")).dropDuplicates()


_MEMBERS = "members AS (SELECT doc_id, source AS collection_id FROM documents UNION SELECT doc_id, lang FROM documents)"


@query(
    "collection_docs",
    f"WITH {_MEMBERS} SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN members m ON m.doc_id = d.doc_id WHERE collection_id = 'de'",
)
def collection_docs(spark, sf):
    members = _memberships(spark, sf).where(F.col("collection_id") == "de").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(members, "doc_id")


@query(
    "doc_collections",
    f"WITH {_MEMBERS} SELECT doc_id, collection_id FROM members WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def doc_collections(spark, sf):
    wanted = table(spark, sf, "labels").select("doc_id")
    return _memberships(spark, sf).join(wanted, "doc_id", "left_semi").select("doc_id", "collection_id")


@query(
    "collection_counts",
    "SELECT c_custkey, c_name, count(o_orderkey) AS doc_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
)
def collection_counts(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    owners = table(spark, sf, "customer").select("c_custkey", "c_name")
    return C.collection_counts(owners, members, "c_custkey", "o_orderkey")


@query(
    "max_collection",
    """SELECT c_nationkey, max(n) AS largest FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_nationkey""",
)
def max_collection(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    owners = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    counts = C.collection_counts(owners, members, "c_custkey", "o_orderkey")
    return counts.groupBy("c_nationkey").agg(F.max("doc_count").alias("largest"))


@query(
    "insert_ignore",
    """WITH old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.event_type = new.event_type)""",
)
def insert_ignore(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    old = events.where(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("event_id")
    )
    return C.insert_or_ignore(old, events.where("event_type <> 'error'"), ["user_id", "event_type"], F.col("event_id"))


@query(
    "upsert_docs",
    """SELECT o_orderkey, coalesce(n, o_orderstatus) AS o_orderstatus, o_orderpriority FROM orders LEFT JOIN (
  SELECT l_orderkey, CASE WHEN max(l_quantity) > 40 THEN 'BIG' END AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def upsert_docs(spark, sf):
    updates = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.max("l_quantity") > 40, "BIG").alias("o_orderstatus")
    )
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.upsert(base, updates, "o_orderkey", ["o_orderstatus"])


@query(
    "latest_per_user",
    """SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_per_user(spark, sf):
    last = C.latest_per(
        table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"]
    )
    return last.select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "recent_turns",
    """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r WHERE back <= 3""",
)
def recent_turns(spark, sf):
    return C.recent(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 3)


@query(
    "sessions_by_user",
    "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS n_events FROM events GROUP BY user_id ORDER BY max(ts) DESC",
)
def sessions_by_user(spark, sf):
    sessions = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_events")
    )
    return sessions.orderBy(F.desc("last")).select(
        "user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "n_events"
    )


_ACTIONS = {"view": "first_upload", "signup": "structured", "purchase": "schema_master", "click": "queried"}
_KEY = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in _ACTIONS.items()) + " END"


@query(
    "milestones",
    f"""WITH k AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events WHERE event_type <> 'error')
SELECT user_id AS session, {_KEY} AS milestone, strftime(ts, '%Y-%m-%d %H:%M:%S') AS earned_at FROM k WHERE n = 1
UNION ALL SELECT user_id, 'power_user', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM k WHERE event_type = 'view' AND n = 5""",
)
def milestones(spark, sf):
    earned = C.milestones(table(spark, sf, "events"), "user_id", "event_type", "ts", _ACTIONS, power_action="view")
    return earned.withColumn("earned_at", F.date_format("earned_at", "yyyy-MM-dd HH:mm:ss"))


# --- tables: filters, sorts, totals over normalised values ------------------------------------------

_PRICE_TEXT = "'$' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')"


def _exact_sum(amount, scale: int):
    """A sum in decimals: the same whatever order the rows arrive in."""
    return F.sum(amount.cast(f"decimal(18,{scale})")).cast("double")


@query("table_filter", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS price FROM orders WHERE floor(o_totalprice) > 300000")
def table_filter(spark, sf):
    texts = table(spark, sf, "orders").select("o_orderkey", F.expr(_PRICE_TEXT).alias("text"))
    return texts.select("o_orderkey", normalise.number(F.col("text")).alias("price")).where("price > 300000")


@query(
    "table_missing",
    """SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_custkey % 7 = 1""",
)
def table_missing(spark, sf):
    """Rows whose name or age is missing under any of the missing tokens."""
    texts = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS name",
        "CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'NOT_AVAILABLE' ELSE '30' END AS age",
    )
    gone = normalise.present(F.col("name")).isNull() | normalise.present(F.col("age")).isNull()
    return texts.where(gone).select("c_custkey")


@query("table_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def table_sort(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(
    "table_by_month",
    """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 4) AS mean FROM lineitem GROUP BY 1""",
)
def table_by_month(spark, sf):
    months = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    sums = months.agg(F.count(F.lit(1)).alias("n"), _exact_sum(F.col("l_extendedprice"), 2).alias("total"))
    return sums.withColumn("mean", F.round(F.col("total") / F.col("n"), 4))


@query(
    "table_totals",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS net,
  round(CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS mean_discount, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL""",
)
def table_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"),
        _exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.round(_exact_sum(F.col("l_discount"), 2) / F.count(F.lit(1)), 6).alias("mean_discount"), F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )
