"""Queries over view recommendations and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import unfold
from quillgrid.operators import views
from quillgrid.operators.profile import with_profile
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query

from quillgrid.sources.files import table

_SCHEMA = """CASE cust % 4 WHEN 0 THEN '{"fields":[{"name":"a","type":"number"},{"name":"b","type":"date"}]}' WHEN 1 THEN '{"fields":[{"name":"a","type":"string"},{"name":"b","type":"date"}]}' WHEN 2 THEN '' ELSE '{"fields":[{"name":"n","type":"number"}]}' END"""

_CHARTS = """CASE WHEN NOT {num} THEN '' WHEN NOT {cat} AND NOT {day} THEN 'bar' ELSE
  array_to_string(list_filter([CASE WHEN {cat} THEN 'bar,pie' END, CASE WHEN {day} THEN 'line' END], lambda x: x IS NOT NULL), ',') END"""
_IS_RECORDS = "(json_type({a}) = 'ARRAY' AND json_array_length({a}) > 0 AND len(list_filter(TRY_CAST({a} AS JSON[]), lambda q: json_type(q) NOT IN ('OBJECT', 'NULL'))) = 0)"
_TYPES = "list_transform(json_keys({o}), lambda k: json_type({o}, '$.' || k))"
_CHART_SQL = f"""{D.ORDER_DOCS_SQL}, cd AS (SELECT doc_id, cust, raw, structured, {_SCHEMA} AS schema_json,
  CASE WHEN structured <> '' AND json_valid(structured) THEN CAST(structured AS JSON) END AS j FROM order_docs),
firsts AS (SELECT *, CASE WHEN j IS NULL THEN [] WHEN {_IS_RECORDS.format(a='j')} THEN {_TYPES.format(o="json_extract(j, '$[0]')")}
  WHEN json_type(j) = 'OBJECT' THEN flatten(list_transform(
    list_filter(list_transform(json_keys(j), lambda m: json_extract(j, '$.' || m)), lambda v: {_IS_RECORDS.format(a='v')}),
    lambda v: {_TYPES.format(o="json_extract(v, '$[0]')")})) ELSE [] END AS kinds,
  contains(schema_json, '"number"') AS s_num, contains(schema_json, '"string"') AS s_cat, contains(schema_json, '"date"') AS s_day FROM cd),
chart_flags AS (SELECT *, CASE WHEN s_num THEN TRUE ELSE len(list_filter(kinds, lambda t: t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'))) > 0 END AS num,
  s_cat OR (NOT s_num AND list_contains(kinds, 'VARCHAR')) AS cat, s_day AS day FROM firsts),
chart_lists AS (SELECT *, CASE WHEN structured = '' THEN '' ELSE {_CHARTS.format(num='num', cat='cat', day='day')} END AS charts FROM chart_flags)"""


def _chart_docs(spark, sf):
    return D.order_docs(spark, sf).withColumn("schema_json", F.expr(_SCHEMA))

#: Bars of the chart query.
BARS = 15


@query("chart_types", f"WITH {_CHART_SQL} SELECT doc_id, charts FROM chart_lists")
def chart_types(spark, sf):
    docs = _chart_docs(spark, sf).withColumn("s", jsontext.strict(F.col("structured"))).withColumn(
        "c", jsontext.strict(F.col("schema_json"))
    )
    charts = F.when(F.col("structured") == "", F.array().cast("array<string>")).otherwise(
        views.chart_types(F.col("s"), F.col("c"))
    )
    return docs.select("doc_id", F.array_join(charts, ",").alias("charts"))


_NOTES = D.MARKDOWN_TEXT + """ || chr(10) || 'sum $5' || chr(10) || 'x1 12' || CASE WHEN turn % 2 = 0 THEN chr(10) || '77' ELSE '' END"""
_RAW_SQL = f"""{D.CSV_CELLS_SQL},
kinds AS (SELECT doc_id, position, CASE WHEN lower(value) IN {D.MISSING_SQL} THEN NULL ELSE {D.classify_sql('value')} END AS kind FROM csv_cells),
cols AS (SELECT doc_id, position, CASE count(DISTINCT kind) WHEN 0 THEN 'null' WHEN 1 THEN min(kind) ELSE 'mixed' END AS type FROM kinds GROUP BY ALL),
csv_flags AS (SELECT doc_id, bool_or(type = 'number') AS num, bool_or(type = 'string') AS cat, bool_or(type = 'date') AS day FROM cols GROUP BY doc_id),
csv_charts AS (SELECT doc_id, {_CHARTS.format(num='num', cat='cat', day='day')} AS charts FROM csv_flags)"""


@query(
    "chart_types_raw",
    f"""WITH {_RAW_SQL} SELECT 'v' || doc_id AS key, charts FROM csv_charts
UNION ALL SELECT 'm' || conv_id || '-' || turn, CASE WHEN len(list_filter(string_split({_NOTES}, chr(10)), lambda l: regexp_matches(l, '\\$[\\d,.]+|\\b\\d{{2,}}\\b'))) >= 3 THEN 'bar' ELSE '' END FROM conversations""",
)
def chart_types_raw(spark, sf):
    notes = table(spark, sf, "conversations").select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"),
        F.expr(_NOTES).alias("text"),
    )
    docs = D.csv_docs(spark, sf).select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("key"), "text")
    profiled = with_profile(docs.unionByName(notes), "text")
    charts = views.chart_types_raw(F.col("text"), F.col("doc_type"), F.col("fields"))
    return profiled.select("key", F.array_join(charts, ",").alias("charts"))


def _reason(name: str) -> str:
    return "'" + K.VIEW_REASONS[name] + "'"


@query(
    "view_tabs",
    f"""WITH {_RAW_SQL.replace('kinds AS', 'csv_kinds AS').replace('FROM kinds', 'FROM csv_kinds')}, {_CHART_SQL},
docs AS (SELECT 'o' || doc_id AS key, TRUE AS has_doc, j IS NOT NULL AND ((json_type(j) = 'ARRAY' AND json_array_length(j) > 0) OR (json_type(j) = 'OBJECT'
    AND len(list_filter(json_keys(j), lambda k: json_array_length(j, '$.' || k) > 1)) > 0)) AS tabular, charts, cust % 3 AS n FROM chart_lists
  UNION ALL SELECT 'v' || doc_id, TRUE, TRUE, charts, 1 FROM csv_charts
  UNION ALL SELECT 'c' || c_custkey, FALSE, FALSE, '', 0 FROM customer)
SELECT key, 'explorer' AS view, TRUE AS enabled, {_reason('explorer')} AS reason, '' AS charts FROM docs
UNION ALL SELECT key, unnest(['summary', 'schema']), has_doc, CASE WHEN has_doc THEN {_reason('uploaded')} ELSE {_reason('upload_first')} END, '' FROM docs
UNION ALL SELECT key, 'table', has_doc AND tabular, CASE WHEN NOT has_doc THEN {_reason('upload_first')} WHEN tabular THEN {_reason('tabular')} ELSE {_reason('not_tabular')} END, '' FROM docs
UNION ALL SELECT key, 'graphs', has_doc AND charts <> '', CASE WHEN NOT has_doc THEN {_reason('upload_first')} WHEN charts <> '' THEN {_reason('numeric')} ELSE {_reason('not_numeric')} END, charts FROM docs
UNION ALL SELECT key, 'oracle', has_doc AND n > 0, CASE WHEN NOT has_doc THEN {_reason('upload_and_collect')} WHEN n >= 2 THEN {_reason('many_documents')}
  WHEN n = 1 THEN {_reason('one_document')} ELSE {_reason('no_documents')} END, '' FROM docs""",
)
def view_tabs(spark, sf):
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string")).alias("key")
    none = F.lit(None).cast("string")
    docs = (
        _chart_docs(spark, sf).select(
            key("o", "doc_id"), F.col("raw").alias("text"), "structured", "schema_json", (F.col("cust") % 3).cast("int").alias("n")
        )
        .unionByName(
            D.csv_docs(spark, sf).select(
                key("v", "doc_id"), "text", none.alias("structured"), none.alias("schema_json"), F.lit(1).alias("n")
            )
        )
        .unionByName(
            table(spark, sf, "customer").select(
                key("c", "c_custkey"), none.alias("text"), none.alias("structured"), none.alias("schema_json"), F.lit(0).alias("n")
            )
        )
    )
    out = views.with_views(with_profile(docs, "text"), "text", "structured", "schema_json", "n")
    return unfold(out, ["key"], F.col("views"), "_i", "view", "v").select(
        "key", "view", "v.enabled", "v.reason", F.array_join("v.chart_types", ",").alias("charts")
    )


@query(
    "chart_bar",
    f"""SELECT '{{"type":"bar","title":"Orders by customer","labels":[' || string_agg('"' || label || '"', ',' ORDER BY value DESC, label) || '],"datasets":[{{"label":"orders","data":['
  || string_agg(CAST(value AS VARCHAR), ',' ORDER BY value DESC, label) || ']}}]}}' AS chart
FROM (SELECT 'c' || o_custkey AS label, count(*) AS value FROM orders GROUP BY 1 ORDER BY value DESC, label LIMIT {BARS})""",
)
def chart_bar(spark, sf):
    label = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    data = views.bar_data(table(spark, sf, "orders"), label, F.lit(1).cast("bigint"), BARS)
    return views.chart_spec(data, "bar", "Orders by customer", "orders", [F.desc("value"), F.col("label")])


@query(
    "chart_line",
    """SELECT '{"type":"line","title":"Orders by month","labels":[' || string_agg('"' || label || '"', ',' ORDER BY label) || '],"datasets":[{"label":"orders","data":['
  || string_agg(CAST(value AS VARCHAR), ',' ORDER BY label) || ']}]}' AS chart
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS label, count(*) AS value FROM orders GROUP BY 1)""",
)
def chart_line(spark, sf):
    data = views.line_data(table(spark, sf, "orders"), F.col("o_orderdate"), F.lit(1).cast("bigint"))
    named = data.select(F.date_format("at", "yyyy-MM").alias("label"), "value")
    return views.chart_spec(named, "line", "Orders by month", "orders", [F.col("label")])


@query(
    "chart_pie",
    f"""WITH s AS (SELECT p_brand AS label, count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn FROM s),
m AS (SELECT CASE WHEN rn <= {K.PIE_SLICES} THEN label ELSE '{K.OTHER_LABEL}' END AS label, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY 1)
SELECT label, value, round(value * 100.0 / (SELECT sum(value) FROM s), 1) AS percent FROM m""",
)
def chart_pie(spark, sf):
    # Lines are counted per part before the join, so only one row per part meets the brand names.
    per_part = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    brands = per_part.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return views.pie_data(brands, F.col("p_brand"), F.col("n"))


@query(
    "axis_ticks",
    f"""WITH t AS (SELECT o_custkey, greatest(max(o_totalprice) / 16, 1.0) AS top FROM orders GROUP BY o_custkey),
v AS (SELECT o_custkey, i AS step, top / {K.AXIS_STEPS} * ({K.AXIS_STEPS} - i) AS val FROM t, range({K.AXIS_STEPS + 1}) r(i))
SELECT o_custkey, step, CAST(floor(val * 100) AS BIGINT) AS cents, CASE WHEN val >= 10000 THEN printf('%.0fk', val / 1000) WHEN val >= 1000 THEN printf('%.1fk', val / 1000) ELSE printf('%.0f', val) END AS label FROM v""",
)
def axis_ticks(spark, sf):
    tops = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") / 16).alias("top"))
    ticks = unfold(tops, ["o_custkey"], views.axis_ticks(F.col("top")), "_i", "t")
    return ticks.select("o_custkey", "t.step", F.floor(F.col("t.value") * 100).alias("cents"), "t.label")


