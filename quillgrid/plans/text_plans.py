"""Queries over raw text: types, values, tokens, sentences, chunks, search in lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import normalise, text
from quillgrid.functions.core import head_lines, trim_ws, unfold
from quillgrid.operators import search
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.session import run_dir
from quillgrid.sources.files import documents_from_files, table

WS = D.WS


def mixed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``key, text``: documents of every type, from all text tables."""
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string")).alias("key")
    parts = [
        D.documents(spark, sf).select(key("d", "doc_id"), "text"),
        D.pages(spark, sf).select(key("p", "page_id"), F.col("html").alias("text")),
        D.order_docs(spark, sf).select(key("o", "doc_id"), F.col("structured").alias("text")),
        D.csv_docs(spark, sf).select(key("v", "doc_id"), "text"),
        D.log_lines(spark, sf).select(key("e", "event_id"), F.col("line").alias("text")),
        table(spark, sf, "customer").select(key("c", "c_custkey"), F.expr(D.KV_TEXT).alias("text")),
        table(spark, sf, "conversations").select(
            F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"),
            F.expr(D.MARKDOWN_TEXT).alias("text"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MIXED_SQL = f"""{D.ORDER_DOCS_SQL}, {D.CSV_CELLS_SQL}, {D.CSV_TEXT_SQL}, {D.LOG_LINES_SQL},
mixed AS (
  SELECT 'd' || doc_id AS key, text FROM documents
  UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT 'o' || doc_id, structured FROM order_docs
  UNION ALL SELECT 'v' || doc_id, text FROM csv_text
  UNION ALL SELECT 'e' || event_id, line FROM log_lines
  UNION ALL SELECT 'c' || c_custkey, {D.KV_TEXT} FROM customer
  UNION ALL SELECT 'm' || conv_id || '-' || turn, {D.MARKDOWN_TEXT} FROM conversations)"""


def _field_count_sql(line: str) -> str:
    bare = f"regexp_replace({line}, '\\r$', '')"
    once = f"""regexp_replace({bare}, '(^|,)"(?:[^"]|"")*"(,|$)', '\\1\\2', 'g')"""
    twice = f"""regexp_replace({once}, '(^|,)"(?:[^"]|"")*"(,|$)', '\\1\\2', 'g')"""
    return f"""CASE WHEN {bare} = '' THEN NULL WHEN contains({twice}, '"') THEN NULL
      ELSE length({twice}) - length(replace({twice}, ',', '')) + 1 END"""


_COUNTS_SQL = f"""trimmed AS (SELECT key, trim(text, '{WS}') AS t FROM mixed),
split_lines AS (SELECT key, t, string_split(t, chr(10)) AS ls FROM trimmed),
counted AS (SELECT key, t, ls, {_field_count_sql('ls[1]')} AS n1, {_field_count_sql('ls[2]')} AS n2 FROM split_lines),
judged AS (
  SELECT key, t, ls, n1, n2,
    CASE WHEN len(ls) < 2 THEN FALSE
      WHEN n1 >= 2 THEN coalesce(n2 BETWEEN n1 - 1 AND n1 + 1, FALSE)
      ELSE contains(ls[1], chr(9)) END AS is_csv FROM counted)"""


def _hits_sql(lines: str, pattern: str) -> str:
    return f"len(list_filter({lines}, lambda x: regexp_matches(trim(x, '{WS}'), '{pattern}')))"


def _type_sql(top: str, head: str) -> str:
    """Types by the rules on lines, which see the given lines."""
    return f"""WITH {MIXED_SQL}, {_COUNTS_SQL}
SELECT key, CASE WHEN t = '' THEN 'unknown'
  WHEN t[1] IN ('{{', '[') AND json_valid(t) THEN 'json'
  WHEN starts_with(t, '<?xml') OR (t[1] = '<' AND regexp_matches(t, '{K.XML_TAG}')) THEN 'xml'
  WHEN is_csv THEN 'csv'
  WHEN {_hits_sql(top, K.LOG_LINE)} > len({top}) // 2 THEN 'log'
  WHEN {_hits_sql(top, K.MARKDOWN_HEADING)} >= 2 THEN 'markdown'
  WHEN {_hits_sql(head, K.KEY_VALUE_LINE)} > len({head}) // 3 THEN 'key_value'
  ELSE 'unknown' END AS doc_type FROM judged"""


@query("detect_type", _type_sql("ls", "ls"))
def detect_type(spark, sf):
    return mixed_documents(spark, sf).select("key", text.doc_type(F.col("text")).alias("doc_type"))


@query("detect_type_window", _type_sql(f"ls[1:{K.TYPE_WINDOW[0]}]", f"ls[1:{K.TYPE_WINDOW[1]}]"))
def detect_type_window(spark, sf):
    """Types by the first lines alone, as some users expect them."""
    return mixed_documents(spark, sf).select("key", text.doc_type(F.col("text"), K.TYPE_WINDOW).alias("doc_type"))


@query(
    "csv_like",
    f"WITH {MIXED_SQL}, {_COUNTS_SQL} SELECT key, n1 AS fields_1, n2 AS fields_2, is_csv FROM judged",
)
def csv_like(spark, sf):
    lines = mixed_documents(spark, sf).select(
        "key", head_lines(trim_ws(F.col("text")), 2).alias("ls")
    )
    return lines.select(
        "key", text.csv_field_count(F.get("ls", F.lit(0))).alias("fields_1"),
        text.csv_field_count(F.get("ls", F.lit(1))).alias("fields_2"), text.csv_like(F.col("ls")).alias("is_csv"),
    )


_VALUES = (
    "CAST(o_orderkey AS STRING)", "'$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)", "o_orderstatus",
    "'c' || CAST(o_custkey AS STRING) || '@example.com'", "'https://example.com/' || CAST(o_orderkey AS STRING)",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'False' END",
    "'€' || CAST(o_custkey AS STRING) || ',000'", "'£' || CAST(o_custkey AS STRING)",
    "CASE o_orderkey % 6 WHEN 0 THEN 'inf' WHEN 1 THEN '1e5' WHEN 2 THEN '1d' WHEN 3 THEN '1_0' WHEN 4 THEN '-' ELSE '.5' END",
    "'March ' || CAST(o_orderkey % 28 + 1 AS STRING) || ', 2024'",
)


@query(
    "classify_value",
    f"""WITH v AS (SELECT o_orderkey, unnest([{', '.join(_VALUES)}]) AS value FROM orders)
SELECT o_orderkey, value, {D.classify_sql('value')} AS kind FROM v""",
)
def classify_value(spark, sf):
    values = F.array(*[F.expr(v) for v in _VALUES])
    listed = unfold(D.orders(spark, sf), ["o_orderkey"], values, "_i", "value").drop("_i")
    return listed.withColumn("kind", text.classify_value(F.col("value")))


@query(
    "tokenize",
    f"""SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts[1:50], ' ') AS head, array_to_string(ts, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{K.TOKEN}') AS ts FROM documents)""",
)
def tokenize(spark, sf):
    docs = D.documents(spark, sf).select("doc_id", text.tokenize(F.col("text")).alias("ts"))
    return docs.select(
        "doc_id", F.size("ts").alias("n_tokens"), F.array_join(F.slice("ts", 1, 50), " ").alias("head"),
        F.array_join("ts", " ").alias("tokens"),
    )


@query(
    "split_sentences",
    f"""WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(text, '{WS}'), '([.!?\n]) ', E'\\\\1\\x01 ', 'g'), chr(1)) AS ss FROM documents)
SELECT doc_id, unnest(places) AS position, unnest(list_transform(ss, lambda x: trim(x, '{WS}'))) AS sentence
FROM (SELECT doc_id, ss, range(len(ss)) AS places FROM s)""",
)
def split_sentences(spark, sf):
    sentences = text.split_sentences(trim_ws(F.col("text")))
    return unfold(D.documents(spark, sf), ["doc_id"], sentences, "position", "sentence")


def chunks_sql(docs: str) -> str:
    """CTEs giving ``chunks(collection_id, doc_id, position, content)`` from ``docs(doc_id, source, text)``."""
    n = K.CHUNK_BYTES
    return f"""chunk_docs AS (SELECT doc_id, source, trim(text, '{WS}') AS t FROM {docs}),
pieces AS (
  SELECT doc_id, source, CASE WHEN strlen(t) <= {n}
    THEN [{{'text': t, 'sep': E'\\n\\n', 'force': FALSE}}]
    ELSE flatten(list_transform(
      list_filter(list_transform(string_split(t, E'\\n\\n'), lambda x: trim(x, '{WS}')), lambda x: x <> ''),
      lambda x: CASE WHEN strlen(x) <= {n} THEN [{{'text': x, 'sep': E'\\n\\n', 'force': FALSE}}]
        ELSE list_transform(string_split(regexp_replace(x, '([.!?\n]) ', E'\\\\1\\x01 ', 'g'), chr(1)),
          lambda s, i: {{'text': trim(s, '{WS}'), 'sep': ' ', 'force': i = 1}}) END)) END AS ps FROM chunk_docs),
folded AS (
  SELECT doc_id, source, list_reduce(
    list_transform(ps, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x.text, 'sep': x.sep, 'force': x.force}}),
    lambda a, x: CASE
      WHEN a.cur = '' THEN {{'done': a.done, 'cur': x.cur, 'sep': x.sep, 'force': x.force}}
      WHEN x.force OR strlen(a.cur) + strlen(x.cur) + strlen(x.sep) > {n}
        THEN {{'done': list_append(a.done, trim(a.cur, '{WS}')), 'cur': x.cur, 'sep': x.sep, 'force': x.force}}
      ELSE {{'done': a.done, 'cur': a.cur || x.sep || x.cur, 'sep': x.sep, 'force': x.force}} END) AS r
  FROM pieces WHERE len(ps) > 0),
chunk_lists AS (
  SELECT doc_id, source, CASE WHEN r.cur = '' THEN r.done ELSE list_append(r.done, trim(r.cur, '{WS}')) END AS cs
  FROM folded),
chunks AS (
  SELECT source AS collection_id, doc_id, unnest(range(len(cs))) AS position, unnest(cs) AS content FROM chunk_lists)"""


@query("chunk_text", f"WITH {chunks_sql('documents')} SELECT collection_id, doc_id, position, content FROM chunks")
def chunk_text(spark, sf):
    return search.chunk(D.documents(spark, sf), "doc_id", "source", "text")


def significant_sql(t: str) -> str:
    words = f"""list_transform(regexp_split_to_array({t}, '[\\t\\n\\x0b\\f\\r \\x{{85}}\\pZ]+'), lambda w: trim(w, '"'',;:()[]{{}}'))"""
    return f"""list_distinct(list_filter({words}, lambda w: strlen(w) >= 2
      AND ((strlen(w) >= 3 AND regexp_matches(w, '^[0-9$]')) OR contains(w, '@'))))"""


@query(
    "significant_tokens",
    f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - o_orderkey, {D.ORDER_RAW} FROM orders)
SELECT doc_id, array_to_string(list_sort({significant_sql('text')}), ' ') AS tokens FROM d""",
)
def significant_tokens(spark, sf):
    docs = D.documents(spark, sf).select("doc_id", "text").unionByName(
        D.orders(spark, sf).select((-1 - F.col("o_orderkey")).alias("doc_id"), F.expr(D.ORDER_RAW).alias("text"))
    )
    return docs.select(
        "doc_id", F.array_join(F.array_sort(text.significant_tokens(F.col("text"))), " ").alias("tokens")
    )


@query(
    "currency_cells",
    f"""WITH {D.CSV_CELLS_SQL}
SELECT doc_id, count(CASE WHEN regexp_matches(trim(value, '{WS}'), '{K.CURRENCY_CELL}') THEN 1 END) AS cells FROM csv_cells GROUP BY doc_id""",
)
def currency_cells(spark, sf):
    return D.csv_docs(spark, sf).select("doc_id", text.currency_cells(F.col("text")).alias("cells"))


NEEDLE = "eRe"
_GREP_SQL = f"""raw_lines AS (
  SELECT doc_id, 1 AS side, 'raw' AS source, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
json_lines AS (
  SELECT doc_id, 2 AS side, 'structured' AS source, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS l
  FROM (SELECT doc_id, string_split('{{"lang":"' || lang || '",' || chr(10) || '"where":"' || source || '"}}', chr(10)) AS ls FROM documents)),
grep_all AS (SELECT * FROM raw_lines UNION ALL SELECT * FROM json_lines),
hits AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY side, line) AS hit, source, line, trim(l, '{WS}') AS text
  FROM grep_all WHERE contains(lower(l), lower('{NEEDLE}')))"""


def _grep_hits(spark, sf):
    docs = D.documents(spark, sf).select(
        "doc_id", "text",
        F.expr("""'{"lang":"' || lang || '",' || chr(10) || '"where":"' || source || '"}'""").alias("structured"),
    )
    return search.grep(docs, "doc_id", "text", "structured", NEEDLE)


@query("grep_lines", f"WITH {_GREP_SQL} SELECT doc_id, hit, source, line, text FROM hits")
def grep_lines(spark, sf):
    return _grep_hits(spark, sf)


@query(
    "grep_highlight",
    f"""WITH {_GREP_SQL}, spots AS (SELECT *, strpos(lower(text), lower('{NEEDLE}')) AS p FROM hits)
SELECT doc_id, hit, substr(text, 1, p - 1) AS before, substr(text, p, {len(NEEDLE)}) AS found,
  substr(text, p + {len(NEEDLE)}) AS after FROM spots""",
)
def grep_highlight(spark, sf):
    hits = _grep_hits(spark, sf).withColumn("h", search.highlight(F.col("text"), NEEDLE))
    return hits.select("doc_id", "hit", "h.before", F.col("h.match").alias("found"), "h.after")


@query(
    "camel_case",
    """WITH w AS (SELECT DISTINCT p_name || ' ' || p_brand AS value FROM part),
s AS (SELECT value, list_filter(string_split_regex(value, '[^A-Za-z0-9]+'), lambda x: x <> '') AS ws FROM w),
b AS (SELECT value, list_transform(ws, lambda x: CASE WHEN upper(x) = x THEN lower(x) ELSE x END) AS ws FROM s)
SELECT value, array_to_string(list_transform(ws, lambda x, i:
  (CASE WHEN i = 1 THEN lower(x[1]) ELSE upper(x[1]) END) || x[2:]), '') AS camel FROM b""",
)
def camel_case(spark, sf):
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("value")).distinct()
    return names.withColumn("camel", normalise.camel_case(F.col("value")))


@query(
    "export_names",
    """SELECT p_partkey, regexp_replace(f, '\\.[^.]*$', '') || '_structured.csv' AS csv_name,
  regexp_replace(f, '\\.[^.]*$', '') || '_schema.json' AS schema_name
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '.') || '.txt' WHEN 1 THEN p_name ELSE p_name || '.tar.gz' END AS f FROM part)""",
)
def export_names(spark, sf):
    from quillgrid.operators.exports import export_name

    name = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '.') || '.txt' WHEN 1 THEN p_name ELSE p_name || '.tar.gz' END"
    )
    files = table(spark, sf, "part").select("p_partkey", name.alias("f"))
    return files.select(
        "p_partkey", export_name(F.col("f"), "csv").alias("csv_name"), export_name(F.col("f"), "schema").alias("schema_name")
    )


@query("ingest_text", "SELECT item_id, text, length(text) AS chars FROM benchmark")
def ingest_text(spark, sf):
    """Every benchmark item as a text file of its own, read back whole."""
    root = run_dir(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(root)
    docs = documents_from_files(spark, root)
    body = F.regexp_replace("raw_content", r"\n\z", "")
    return docs.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), body.alias("text"),
        F.length(body).alias("chars"),
    )
