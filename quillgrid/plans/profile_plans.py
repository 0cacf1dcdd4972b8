"""Queries over inferred schemas: profiles, clean reports, keys, references, outliers, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import unfold_present
from quillgrid.operators import collections, discovery, heavy, profile
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.session import materialise
from quillgrid.sources.files import table

_FIELDS = f"""{D.CSV_CELLS_SQL},
kinds AS (SELECT *, CASE WHEN lower(value) IN {D.MISSING_SQL} THEN NULL ELSE {D.classify_sql('value')} END AS kind FROM csv_cells),
fields AS (
  SELECT doc_id, position, name, count(*) AS n_rows, count(CASE WHEN value = '' THEN 1 END) AS empty_count, count(DISTINCT kind) AS n_kinds,
    CASE count(DISTINCT kind) WHEN 0 THEN 'null' WHEN 1 THEN min(kind) ELSE 'mixed' END AS type,
    count(DISTINCT value) FILTER (value <> '') AS n_distinct,
    array_to_string((list(value ORDER BY n) FILTER (value <> ''))[1:3], '|') AS samples
  FROM kinds GROUP BY doc_id, position, name)"""


def _profiled(spark, sf):
    return profile.with_profile(D.csv_docs(spark, sf), "text")


@query(
    "profile_csv",
    f"""WITH {_FIELDS} SELECT doc_id, position, name, type, empty_count > 0 AS nullable,
  n_distinct = n_rows - empty_count AND n_distinct > 0 AS is_unique, empty_count FROM fields""",
)
def profile_csv(spark, sf):
    fields = profile.profile_fields(_profiled(spark, sf), "doc_id")
    return fields.select(
        "doc_id", "position", "name", "type", "nullable", F.col("unique").alias("is_unique"), "empty_count"
    )


@query("profile_samples", f"WITH {_FIELDS} SELECT doc_id, name, coalesce(samples, '') AS samples FROM fields")
def profile_samples(spark, sf):
    fields = profile.profile_fields(_profiled(spark, sf), "doc_id")
    return fields.select("doc_id", "name", F.array_join("sample_values", "|").alias("samples"))


@query(
    "profile_issues",
    f"""WITH {_FIELDS}, i AS (
  SELECT doc_id, position * 2 AS o, name || ': ' || empty_count || ' empty values (' || (empty_count * 100 // n_rows) || '%)' AS issue FROM fields WHERE empty_count > 0
  UNION ALL SELECT doc_id, position * 2 + 1, name || ': {K.ISSUE_MIXED}' FROM fields WHERE type = 'mixed'),
d AS (SELECT doc_id, max(n_rows) AS row_count, count(*) AS field_count FROM fields GROUP BY doc_id)
SELECT d.doc_id, 'csv' AS doc_type, row_count, field_count, coalesce(string_agg(issue, '; ' ORDER BY o), '') AS issues
FROM d LEFT JOIN i ON i.doc_id = d.doc_id GROUP BY d.doc_id, row_count, field_count""",
)
def profile_issues(spark, sf):
    return _profiled(spark, sf).select(
        "doc_id", "doc_type", "row_count", "field_count", F.array_join("issues", "; ").alias("issues")
    )


@query(
    "clean_report",
    f"""WITH {_FIELDS},
money AS (SELECT doc_id, count(CASE WHEN regexp_matches(value, '{K.CURRENCY_CELL}') THEN 1 END) AS currency_values FROM csv_cells GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(n_rows) AS BIGINT) AS total_values, CAST(sum(empty_count) AS BIGINT) AS empty_values,
    count(CASE WHEN type = 'date' THEN 1 END) AS date_columns, CAST(sum(CASE WHEN type = 'email' THEN n_rows - empty_count ELSE 0 END) AS BIGINT) AS email_values,
    string_agg(name, ', ' ORDER BY position) FILTER (type = 'mixed') AS mixed FROM fields GROUP BY doc_id),
a AS (SELECT *, list_filter([
    CASE WHEN empty_values > 0 THEN 'Data has ' || (empty_values * 100 // greatest(total_values, 1)) || '{K.ADVICE_MISSING}' END,
    CASE WHEN mixed IS NOT NULL THEN 'Columns with mixed types: ' || mixed || '{K.ADVICE_MIXED}' END,
    CASE WHEN currency_values > 0 THEN '{K.ADVICE_CURRENCY}' END, CASE WHEN date_columns > 1 THEN '{K.ADVICE_DATES}' END],
    lambda x: x IS NOT NULL) AS s FROM c JOIN money USING (doc_id))
SELECT doc_id, total_values, empty_values, currency_values, date_columns, email_values, coalesce(mixed, '') AS mixed_columns,
  array_to_string(s, '; ') AS suggestions FROM a""",
)
def clean_report(spark, sf):
    out = profile.with_clean_report(_profiled(spark, sf), "text")
    return out.select(
        "doc_id", "clean.total_values", "clean.empty_values", "clean.currency_values", "clean.date_columns",
        "clean.email_values", F.array_join("clean.mixed_type_columns", ", ").alias("mixed_columns"),
        F.array_join("clean.suggestions", "; ").alias("suggestions"),
    )


# --- a whole table as one document ------------------------------------------------------------

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS row_key, '{c}' AS field, coalesce(trim(CAST({c} AS VARCHAR)), '') AS value FROM orders"
    for c in _COLUMNS
) + f"""), typed AS (SELECT *, CASE WHEN lower(value) IN {D.MISSING_SQL} THEN NULL ELSE {D.classify_sql('value')} END AS kind FROM cells),
prof AS (SELECT field, count(*) AS row_count, count(CASE WHEN value = '' THEN 1 END) AS empty_count, count(DISTINCT value) FILTER (value <> '') AS distinct_count,
  CASE count(DISTINCT kind) WHEN 0 THEN 'null' WHEN 1 THEN min(kind) ELSE 'mixed' END AS type FROM typed GROUP BY field)"""


def _counts(spark, sf):
    return profile.value_counts(table(spark, sf, "orders"), "o_orderkey", _COLUMNS)


@query(
    "profile_table",
    f"""WITH {_CELLS} SELECT field, row_count, empty_count, distinct_count, type, empty_count > 0 AS nullable,
  distinct_count = row_count - empty_count AND distinct_count > 0 AS is_unique FROM prof""",
)
def profile_table(spark, sf):
    return profile.profile_values(_counts(spark, sf)).withColumnRenamed("unique", "is_unique")


@query(
    "profile_first_values",
    f"""WITH {_CELLS}, r AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY row_key, value) AS rank FROM cells WHERE value <> '')
SELECT field, rank, value FROM r WHERE rank <= 3""",
)
def profile_first_values(spark, sf):
    return profile.first_values(profile.cells_of(table(spark, sf, "orders"), "o_orderkey", _COLUMNS))


@query(
    "profile_enum_key",
    f"""WITH {_CELLS} SELECT field, distinct_count, distinct_count BETWEEN 1 AND 9 AS is_enum,
  distinct_count = row_count AND empty_count = 0 AS is_key FROM prof""",
)
def profile_enum_key(spark, sf):
    return profile.enums_and_keys(profile.profile_values(_counts(spark, sf)))


_LINKS = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
]


@query(
    "profile_references",
    " UNION ALL ".join(
        f"""SELECT '{ck}' AS child, '{pk}' AS parent, count(*) AS child_values, count(CASE WHEN n IS NULL THEN 1 END) AS orphans,
  count(CASE WHEN n IS NULL THEN 1 END) = 0 AND count(CASE WHEN n > 1 THEN 1 END) = 0 AS is_reference
FROM (SELECT DISTINCT {ck} AS v FROM {ct} WHERE {ck} IS NOT NULL) LEFT JOIN (SELECT {pk} AS v, count(*) AS n FROM {pt} GROUP BY {pk}) USING (v)"""
        for ct, ck, pt, pk in _LINKS
    ),
)
def profile_references(spark, sf):
    parts = [
        profile.references(table(spark, sf, ct), ck, table(spark, sf, pt), pk) for ct, ck, pt, pk in _LINKS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("references", "is_reference")


_DISCOVERED = {
    "region": {"integer": ["r_regionkey"], "text": ["r_name"]},
    "nation": {"integer": ["n_nationkey", "n_regionkey"], "text": ["n_name"]},
    "supplier": {"integer": ["s_suppkey", "s_nationkey"], "text": ["s_name"], "number": ["s_acctbal"]},
    "customer": {"integer": ["c_custkey", "c_nationkey"], "text": ["c_name", "c_mktsegment"], "number": ["c_acctbal"]},
    "orders": {"integer": ["o_orderkey", "o_custkey"], "text": ["o_orderstatus", "o_orderpriority"], "number": ["o_totalprice"], "time": ["o_orderdate"]},
}


def _every_pair_sql() -> str:
    """Every ordered pair of columns of one class, by EXCEPT."""
    columns = [(t, c, k) for t, kinds in _DISCOVERED.items() for k, names in kinds.items() for c in names]
    return " UNION ALL ".join(
        f"""SELECT '{ct}' AS child_table, '{cc}' AS child, '{pt}' AS parent_table, '{pc}' AS parent,
  (SELECT count(DISTINCT {cc}) FROM {ct}) AS child_values, (SELECT count(*) FROM (SELECT {cc} FROM {ct} WHERE {cc} IS NOT NULL EXCEPT SELECT {pc} FROM {pt})) AS orphans,
  (SELECT count({pc}) = count(DISTINCT {pc}) FROM {pt}) AS parent_unique"""
        for ct, cc, ck in columns for pt, pc, pk in columns if ck == pk and (ct, cc) != (pt, pc))


@query(
    "reference_discovery",
    f"WITH pairs AS ({_every_pair_sql()}) SELECT child_table, child, parent_table, parent, child_values, parent_unique FROM pairs WHERE orphans = 0",
)
def reference_discovery(spark, sf):
    """All inclusions among the columns of five tables; those into a unique column are references."""
    tables = {t: table(spark, sf, t) for t in _DISCOVERED}
    found = discovery.reference_candidates(tables).where("orphans = 0")
    return found.select("child_table", "child", "parent_table", "parent", "child_values", "parent_unique")


@query(
    "profile_outliers",
    """WITH c AS (SELECT event_id AS row_key, 'value' AS field, value FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events),
q AS (SELECT field, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM c GROUP BY field)
SELECT row_key, field, round(value, 6) AS value, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high
FROM c JOIN q USING (field) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def profile_outliers(spark, sf):
    found = profile.outliers(table(spark, sf, "events"), "event_id", ["value", "user_id"])
    return found.select(
        "row_key", "field", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")]
    )


@query(
    "summary_facts",
    f"""WITH {_CELLS},
tops AS (SELECT field, value AS top_value, n AS top_count FROM (
  SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM cells WHERE value <> '' GROUP BY field, value) WHERE r = 1),
nums AS (SELECT 'o_orderkey' AS field, CAST(min(o_orderkey) AS DOUBLE) AS low, CAST(max(o_orderkey) AS DOUBLE) AS high, avg(o_orderkey) AS mean FROM orders
  UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), avg(o_custkey) FROM orders)
SELECT field, type, row_count, top_value, top_count, low, high, round(mean, 4) AS mean FROM prof JOIN tops USING (field) LEFT JOIN nums USING (field)""",
)
def summary_facts(spark, sf):
    counts = materialise(_counts(spark, sf), "counts")
    numbers = profile.typed_facts(counts).select("field", "low", "high", F.round("mean", 4).alias("mean"))
    return (
        profile.profile_values(counts).select("field", "type", "row_count")
        .join(profile.top_value(counts), "field").join(numbers, "field", "left")
    )


_TOP_OF = ("l_returnflag", "l_quantity", "l_shipdate", "l_partkey", "l_orderkey")


@query(
    "top_values",
    "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(CAST({c} AS {t}) AS VARCHAR) AS value FROM lineitem"
        for c, t in zip(_TOP_OF, ("VARCHAR", "BIGINT", "DATE", "BIGINT", "BIGINT"))) + """),
counts AS (SELECT field, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM counts)
SELECT field, CAST(rank AS INT) AS rank, value, n FROM ranked WHERE rank <= 5""",
)
def top_values(spark, sf):
    """The five most frequent values of columns with few, many and almost unique values."""
    lines = table(spark, sf, "lineitem").withColumns({"l_quantity": F.col("l_quantity").cast("bigint"), "l_shipdate": F.col("l_shipdate").cast("date")})
    return heavy.top_values(lines, list(_TOP_OF), 5)


# --- comparison across documents -----------------------------------------------------------------


def _json_fields(spark, sf):
    keys = F.map_keys(jsontext.as_object(jsontext.strict(F.col("structured"))))
    return unfold_present(D.order_docs(spark, sf), ["doc_id"], keys, "ks")


_KEYS = f"""{D.ORDER_DOCS_SQL}, ks AS (SELECT doc_id, json_keys(CAST(structured AS JSON)) AS ks FROM order_docs
  WHERE structured <> '' AND json_valid(structured) AND json_type(structured) = 'OBJECT')"""


@query(
    "compare_docs",
    f"""WITH {_KEYS}, p AS (SELECT DISTINCT doc_id, unnest(ks) AS field FROM ks)
SELECT field, count(*) AS documents, (SELECT count(DISTINCT doc_id) FROM p) AS total_documents,
  count(*) = (SELECT count(DISTINCT doc_id) FROM p) AS shared FROM p GROUP BY field""",
)
def compare_docs(spark, sf):
    return collections.compare_fields(_json_fields(spark, sf), "ks")


_BY_COLLECTION = f"""{D.ORDER_DOCS_SQL}, ks AS (SELECT doc_id, cust % 7 AS collection, json_keys(CAST(structured AS JSON)) AS ks FROM order_docs
  WHERE structured <> '' AND json_valid(structured) AND json_type(structured) = 'OBJECT' AND doc_id % 10 + cust % 7 <> 9),
f AS (SELECT collection, unnest(list_distinct(ks)) AS field FROM ks),
t AS (SELECT collection, count(*) AS total_documents FROM ks WHERE len(ks) > 0 GROUP BY collection),
c AS (SELECT collection, field, count(*) AS documents, any_value(total_documents) AS total_documents, count(*) = any_value(total_documents) AS shared FROM f JOIN t USING (collection) GROUP BY ALL)"""


def _collection_fields(spark, sf):
    """Documents of seven collections, six of which lack one shape of document each."""
    keys = F.map_keys(jsontext.as_object(jsontext.strict(F.col("structured"))))
    docs = D.order_docs(spark, sf).where("doc_id % 10 + cust % 7 <> 9").withColumn("collection", F.col("cust") % 7)
    return unfold_present(docs, ["doc_id", "collection"], keys, "ks")


@query("compare_in_collections", f"WITH {_BY_COLLECTION} SELECT collection, field, documents, total_documents, shared FROM c")
def compare_in_collections(spark, sf):
    """Which fields the documents of each collection share."""
    return collections.compare_in_collections(_collection_fields(spark, sf), "collection", "ks")


@query(
    "document_field_totals",
    f"""WITH {_BY_COLLECTION}, s AS (SELECT collection, count(*) FILTER (shared) AS n FROM c GROUP BY collection)
SELECT doc_id, k.collection, CAST(len(ks) AS BIGINT) AS n_fields, CASE WHEN len(ks) > 0 THEN coalesce(n, 0) ELSE 0 END AS shared_fields,
  CAST(len(ks) - CASE WHEN len(ks) > 0 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS different_fields FROM ks k LEFT JOIN s ON s.collection = k.collection""",
)
def document_field_totals(spark, sf):
    docs = materialise(_collection_fields(spark, sf), "fields")
    return collections.document_field_totals(docs, "doc_id", "collection", "ks", collections.compare_in_collections(docs, "collection", "ks"))


@query(
    "compare_pairs",
    f"""WITH {_KEYS} SELECT a.doc_id, array_to_string(list_sort(list_filter(a.ks, lambda x: NOT list_contains(b.ks, x))), ',') AS only_left,
  array_to_string(list_sort(list_filter(b.ks, lambda x: NOT list_contains(a.ks, x))), ',') AS only_right,
  array_to_string(list_sort(list_intersect(a.ks, b.ks)), ',') AS in_both
FROM ks a JOIN ks b ON b.doc_id = a.doc_id + 1""",
)
def compare_pairs(spark, sf):
    left = _json_fields(spark, sf)
    right = left.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ks").alias("other"))
    both = left.join(right, "doc_id").withColumn("d", collections.field_difference(F.col("ks"), F.col("other")))
    return both.select(
        "doc_id", F.array_join("d.only_left", ",").alias("only_left"),
        F.array_join("d.only_right", ",").alias("only_right"), F.array_join("d.both", ",").alias("in_both"),
    )
