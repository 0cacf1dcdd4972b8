"""Queries over structured JSON: shapes, profiles, quality scores, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import let, trim_ws, unfold, unfold_present
from quillgrid.operators import exports, parsers, quality
from quillgrid.operators.profile import profile_fields, schema_struct, with_profile
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.plans.text_plans import significant_sql

_VALID = f"""{D.ORDER_DOCS_SQL},
valid AS (SELECT doc_id, raw, structured, CAST(structured AS JSON) AS j FROM order_docs
  WHERE structured <> '' AND json_valid(structured))"""
_TREE = f"""{_VALID},
tree AS (SELECT v.doc_id, t.id, t.parent, t.type, t.key, t.fullkey, t.atom, t.value
  FROM valid v, json_tree(v.j) t),
nodes AS (SELECT t.*, p.type AS parent_type FROM tree t LEFT JOIN tree p ON p.doc_id = t.doc_id AND p.id = t.parent)"""
_TEXT = "CASE WHEN type = 'NULL' THEN '' WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') ELSE CAST(value AS VARCHAR) END"


def _parsed(spark, sf):
    return D.order_docs(spark, sf).withColumn("v", jsontext.strict(F.col("structured")))


def _valid(spark, sf):
    docs = D.order_docs(spark, sf)
    return unfold_present(docs, ["doc_id", "raw", "structured"], jsontext.strict(F.col("structured")), "v")


@query(
    "json_shape",
    f"""WITH {D.ORDER_DOCS_SQL}, t AS (SELECT doc_id, CASE WHEN structured <> '' AND json_valid(structured) THEN CAST(structured AS JSON) END AS j FROM order_docs),
s AS (SELECT doc_id, j, CASE WHEN json_type(j) = 'OBJECT' THEN 'object'
  WHEN json_type(j) = 'ARRAY' AND json_array_length(j) > 0
    AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) NOT IN ('OBJECT', 'NULL'))) = 0 THEN 'records'
  ELSE 'error' END AS shape FROM t)
SELECT doc_id, shape, CAST(CASE shape WHEN 'object' THEN 1 WHEN 'records' THEN json_array_length(j) ELSE 0 END AS BIGINT) AS n_rows FROM s""",
)
def json_shape(spark, sf):
    from quillgrid.sources.files import json_shape as shape

    docs = D.order_docs(spark, sf).withColumn("s", shape(F.col("structured")))
    return docs.select("doc_id", "s.shape", F.col("s.rows").alias("n_rows"))


@query(
    "json_types",
    f"""WITH {_VALID}, members AS (SELECT doc_id, unnest(json_keys(j)) AS key, j FROM valid WHERE json_type(j) = 'OBJECT')
SELECT doc_id, key, CASE json_type(j, '$."' || key || '"') WHEN 'OBJECT' THEN 'string' WHEN 'ARRAY' THEN 'string'
  WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM members""",
)
def json_types(spark, sf):
    members = unfold(_parsed(spark, sf), ["doc_id"], jsontext.as_object(F.col("v")), "_i", "key", "value")
    return members.select("doc_id", "key", jsontext.field_type(F.col("value")).alias("kind"))


@query(
    "profile_json",
    f"""WITH {_TREE},
roots AS (SELECT doc_id, id, type FROM nodes WHERE parent IS NULL),
recs AS (SELECT n.doc_id, n.id, CAST(n.key AS INT) AS pos FROM nodes n JOIN roots r ON r.doc_id = n.doc_id AND n.parent = r.id
  WHERE r.type = 'ARRAY' AND n.type = 'OBJECT'
    AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.doc_id = n.doc_id AND x.parent = r.id AND x.type NOT IN ('OBJECT', 'NULL'))),
n_recs AS (SELECT doc_id, count(*) AS n FROM recs GROUP BY doc_id),
cells AS (SELECT r.doc_id, r.pos, n.key AS field, n.value, CASE n.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
    WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'string' WHEN 'ARRAY' THEN 'string' ELSE 'number' END AS kind
  FROM recs r JOIN nodes n ON n.doc_id = r.doc_id AND n.parent = r.id)
SELECT c.doc_id, field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS type,
  count(CASE WHEN kind = 'null' THEN 1 END) AS empty_count, max(n) - count(*) AS missing_count,
  array_to_string(list(CAST(value AS VARCHAR) ORDER BY pos) FILTER (kind <> 'null')[1:3], '|') AS samples
FROM cells c JOIN n_recs USING (doc_id) GROUP BY c.doc_id, field""",
)
def profile_json(spark, sf):
    # Only arrays of records have fields among the texts that start as arrays.
    records = D.order_docs(spark, sf).where(trim_ws(F.col("structured")).startswith("["))
    fields = profile_fields(with_profile(records, "structured"), "doc_id")
    return fields.select(
        "doc_id", F.col("name").alias("field"), "type", "empty_count", "missing_count",
        F.array_join("sample_values", "|").alias("samples"),
    )


@query(
    "profile_json_objects",
    # Members of a nested object are ordered by name, as a variant keeps them.
    f"""WITH {_TREE},
ordered AS (SELECT doc_id, parent AS id, '{{' || string_agg(CAST(to_json(key) AS VARCHAR) || ':' || COALESCE(CAST(value AS VARCHAR), 'null'), ',' ORDER BY key) || '}}' AS text
  FROM nodes WHERE parent_type = 'OBJECT' GROUP BY doc_id, parent)
SELECT n.doc_id, n.key AS field, CASE n.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
    WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'string' WHEN 'ARRAY' THEN 'string' ELSE 'number' END AS type,
  0 AS empty_count, 0 AS missing_count, COALESCE(o.text, CAST(n.value AS VARCHAR), 'null') AS sample
FROM nodes n JOIN nodes r ON r.doc_id = n.doc_id AND r.id = n.parent LEFT JOIN ordered o ON o.doc_id = n.doc_id AND o.id = n.id WHERE r.parent IS NULL AND r.type = 'OBJECT'""",
)
def profile_json_objects(spark, sf):
    # The other texts that have fields; profile_json takes those that start as arrays.
    others = D.order_docs(spark, sf).where(~trim_ws(F.col("structured")).startswith("["))
    fields = profile_fields(with_profile(others, "structured"), "doc_id")
    return fields.select(
        "doc_id", F.col("name").alias("field"), "type", "empty_count", "missing_count", F.col("sample_values")[0].alias("sample"),
    )


@query(
    "quality_completeness",
    f"""WITH {_TREE}, m AS (SELECT doc_id, count(*) AS n, count(CASE WHEN type = 'NULL' OR (type = 'VARCHAR' AND json_extract_string(value, '$') = '') THEN 1 END) AS gone
  FROM nodes WHERE parent_type = 'OBJECT' GROUP BY doc_id)
SELECT v.doc_id, CASE WHEN n IS NULL THEN 50 ELSE 100 - gone * 100 // n END AS completeness FROM valid v LEFT JOIN m USING (doc_id)""",
)
def quality_completeness(spark, sf):
    return _valid(spark, sf).select("doc_id", quality.completeness(F.col("v")).alias("completeness"))


_NAMING = """CASE WHEN len({k}) = 0 THEN 70 ELSE 50 + greatest(
    len(list_filter({k}, lambda x: contains(x, '_'))),
    len(list_filter({k}, lambda x: NOT contains(x, '_') AND regexp_matches(x, '^[a-z]')))) * 50 // len({k}) END"""
_CONSISTENCY = f"""rec_lists AS (
  SELECT doc_id, j, json_type(j) AS jt, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') END AS own,
    CASE WHEN json_type(j) = 'OBJECT' THEN list_sort(json_keys(j)) END AS ks FROM valid),
nested AS (
  SELECT *, list_filter(list_transform(ks, lambda k: CASE WHEN json_type(j, '$.' || k) = 'ARRAY' THEN CAST(json_extract(j, '$.' || k) AS JSON[]) END),
    lambda a: len(a) > 1 AND len(list_filter(a, lambda x: json_type(x) NOT IN ('OBJECT', 'NULL'))) = 0)[1] AS inner_rows FROM rec_lists),
picked AS (
  SELECT doc_id, jt, ks, CASE WHEN len(own) > 1 AND len(list_filter(own, lambda x: json_type(x) NOT IN ('OBJECT', 'NULL'))) = 0 THEN own
    ELSE inner_rows END AS rs FROM nested),
consistent AS (
  SELECT doc_id, CASE WHEN rs IS NOT NULL THEN
      CAST(list_sum(list_transform(rs[2:], lambda r: len(list_intersect(json_keys(rs[1]), json_keys(r))) * 100 // len(json_keys(rs[1])))) AS BIGINT) // (len(rs) - 1)
    WHEN jt = 'OBJECT' THEN {_NAMING.format(k='ks')} WHEN jt = 'NULL' THEN 70 ELSE 60 END AS consistency FROM picked)"""


@query("quality_consistency", f"WITH {_VALID}, {_CONSISTENCY} SELECT doc_id, consistency FROM consistent")
def quality_consistency(spark, sf):
    return _valid(spark, sf).select("doc_id", quality.consistency(F.col("v")).alias("consistency"))


@query(
    "naming_consistency",
    f"WITH {_VALID}, o AS (SELECT doc_id, json_keys(j) AS ks FROM valid WHERE json_type(j) = 'OBJECT') SELECT doc_id, {_NAMING.format(k='ks')} AS score FROM o",
)
def naming_consistency(spark, sf):
    keys = F.map_keys(jsontext.as_object(jsontext.strict(F.col("structured"))))
    docs = unfold_present(D.order_docs(spark, sf), ["doc_id"], keys, "ks")
    return docs.select("doc_id", quality.naming_consistency(F.col("ks")).alias("score"))


_VALIDITY = f"""token_sets AS (SELECT doc_id, {significant_sql('raw')} AS rt, {significant_sql('structured')} AS st FROM valid),
validities AS (SELECT doc_id, CASE WHEN len(rt) = 0 THEN 60 ELSE len(list_intersect(rt, st)) * 100 // len(rt) END AS validity FROM token_sets)"""


@query("quality_validity", f"WITH {_VALID}, {_VALIDITY} SELECT doc_id, validity FROM validities")
def quality_validity(spark, sf):
    return _valid(spark, sf).select(
        "doc_id", quality.validity(F.col("raw"), F.col("structured")).alias("validity")
    )


_TWO = "(json_type({m}) = 'OBJECT' OR (json_type({m}) = 'ARRAY' AND json_array_length({m}) > 0))"
_MEMBERS = "list_transform(json_keys({j}), lambda k: json_extract({j}, '$.' || k))"
_STRUCTURE = f"""structures AS (SELECT doc_id, CASE
  WHEN json_type(j) = 'ARRAY' THEN CASE WHEN json_array_length(j) = 0 THEN 30
    WHEN json_type(j, '$[0]') <> 'OBJECT' THEN 55
    WHEN len(list_filter({_MEMBERS.format(j="json_extract(j, '$[0]')")}, lambda m: {_TWO.format(m='m')})) > 0 THEN 95 ELSE 85 END
  WHEN json_type(j) = 'OBJECT' THEN CASE WHEN len(json_keys(j)) = 0 THEN 20
    WHEN len(list_filter({_MEMBERS.format(j='j')}, lambda m: json_type(m) = 'ARRAY')) > 0 THEN
      CASE WHEN len(list_filter({_MEMBERS.format(j='j')}, lambda m: coalesce(json_type(m, '$[0]') = 'OBJECT', FALSE)
        OR (json_type(m) = 'OBJECT' AND len(list_filter({_MEMBERS.format(j='m')}, lambda x: {_TWO.format(m='x')})) > 0))) > 0 THEN 95 ELSE 85 END
    WHEN len(list_filter({_MEMBERS.format(j='j')}, lambda m: {_TWO.format(m='m')})) > 0 THEN 75 ELSE 60 END
  ELSE 30 END AS structure FROM valid)"""


@query("quality_structure", f"WITH {_VALID}, {_STRUCTURE} SELECT doc_id, structure FROM structures")
def quality_structure(spark, sf):
    return _valid(spark, sf).select("doc_id", quality.structure(F.col("v")).alias("structure"))


_GRADE = "CASE " + " ".join(f"WHEN score >= {n} THEN '{g}'" for n, g in K.GRADES) + f" ELSE '{K.LOWEST_GRADE}' END"


@query(
    "quality_score",
    f"""WITH {_TREE}, m AS (SELECT doc_id, count(*) AS n, count(CASE WHEN type = 'NULL' OR (type = 'VARCHAR' AND json_extract_string(value, '$') = '') THEN 1 END) AS gone
  FROM nodes WHERE parent_type = 'OBJECT' GROUP BY doc_id),
complete AS (SELECT v.doc_id, CASE WHEN n IS NULL THEN 50 ELSE 100 - gone * 100 // n END AS completeness FROM valid v LEFT JOIN m USING (doc_id)),
{_CONSISTENCY}, {_VALIDITY}, {_STRUCTURE},
scored AS (SELECT doc_id, completeness, consistency, validity, structure,
    (completeness * 30 + consistency * 25 + validity * 20 + structure * 25) // 100 AS score
  FROM complete JOIN consistent USING (doc_id) JOIN validities USING (doc_id) JOIN structures USING (doc_id)),
advised AS (SELECT *, list_filter([CASE WHEN completeness < 80 THEN '{K.ADVICE_COMPLETENESS}' END, CASE WHEN consistency < 70 THEN '{K.ADVICE_CONSISTENCY}' END,
    CASE WHEN validity < 70 THEN '{K.ADVICE_VALIDITY}' END, CASE WHEN structure < 70 THEN '{K.ADVICE_STRUCTURE}' END], lambda x: x IS NOT NULL) AS advice FROM scored)
SELECT doc_id, score, {_GRADE} AS grade, 'scored' AS status, completeness, consistency, validity, structure,
  CASE WHEN len(advice) = 0 AND score >= 85 THEN '{K.ADVICE_GOOD}' ELSE array_to_string(advice, '; ') END AS suggestions FROM advised
UNION ALL SELECT doc_id, CASE WHEN structured = '' THEN 0 ELSE 25 END, CASE WHEN structured = '' THEN '-' ELSE 'F' END,
  CASE WHEN structured = '' THEN 'pending' ELSE 'scored' END, CASE WHEN structured = '' THEN 0 ELSE 25 END, CASE WHEN structured = '' THEN 0 ELSE 25 END,
  CASE WHEN structured = '' THEN 0 ELSE 25 END, CASE WHEN structured = '' THEN 0 ELSE 25 END,
  CASE WHEN structured = '' THEN '{K.ADVICE_PENDING}' ELSE '{K.ADVICE_INVALID}' END
FROM order_docs WHERE structured = '' OR NOT json_valid(structured)""",
)
def quality_score(spark, sf):
    docs = quality.with_quality(D.order_docs(spark, sf), "raw", "structured")
    return docs.select(
        "doc_id", "quality.score", "quality.grade", "quality.status", "quality.breakdown.*",
        F.array_join("quality.suggestions", "; ").alias("suggestions"),
    )


@query(
    "json_depth",
    f"""WITH RECURSIVE {_TREE},
firsts AS (SELECT doc_id, parent AS arr, id, type FROM nodes WHERE parent_type = 'ARRAY' AND key = '0'),
edges AS (SELECT doc_id, parent AS src, id AS dst, 1 AS step FROM nodes WHERE parent_type = 'OBJECT' AND type = 'OBJECT'
  UNION ALL SELECT n.doc_id, n.parent, CASE WHEN f.type = 'OBJECT' THEN f.id END, CASE WHEN f.type = 'OBJECT' THEN 2 ELSE 1 END
  FROM nodes n JOIN firsts f ON f.doc_id = n.doc_id AND f.arr = n.id WHERE n.parent_type = 'OBJECT' AND n.type = 'ARRAY'),
walk AS (SELECT doc_id, id, 1 AS level FROM nodes WHERE parent IS NULL AND type = 'OBJECT'
  UNION ALL SELECT w.doc_id, e.dst, w.level + e.step FROM walk w JOIN edges e ON e.doc_id = w.doc_id AND e.src = w.id)
SELECT doc_id, max(level) AS depth FROM walk GROUP BY doc_id""",
)
def json_depth(spark, sf):
    return unfold_present(_parsed(spark, sf), ["doc_id"], jsontext.depth(F.col("v")), "depth")


@query(
    "flatten_kv",
    f"""WITH RECURSIVE {_VALID},
walk AS (SELECT doc_id, '' AS path, j AS v FROM valid WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT doc_id, CASE path WHEN '' THEN k ELSE path || '.' || k END, json_extract(v, '$."' || k || '"')
  FROM (SELECT doc_id, path, v, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT'))
SELECT doc_id, path AS field, CASE json_type(v) WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END AS value
FROM walk WHERE json_type(v) <> 'OBJECT'""",
)
def flatten_kv(spark, sf):
    return parsers.flat_json(D.order_docs(spark, sf), "doc_id", "structured")


_EXPORT = f"""{_TREE},
roots AS (SELECT doc_id, id, type FROM nodes WHERE parent IS NULL),
root_rows AS (SELECT n.doc_id, n.fullkey AS base, CAST(n.key AS INT) AS pos FROM nodes n JOIN roots r ON r.doc_id = n.doc_id AND n.parent = r.id
  WHERE r.type = 'ARRAY' AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.doc_id = n.doc_id AND x.parent = r.id AND x.type NOT IN ('OBJECT', 'NULL'))),
arrays AS (SELECT a.doc_id, a.id, substr(a.fullkey, 3) AS path, count(e.id) AS n
  FROM nodes a JOIN roots r ON r.doc_id = a.doc_id AND r.type = 'OBJECT'
  LEFT JOIN nodes e ON e.doc_id = a.doc_id AND e.parent = a.id AND e.type = 'OBJECT'
  WHERE a.type = 'ARRAY' AND NOT contains(a.fullkey, '[') GROUP BY ALL),
best AS (SELECT doc_id, id, path, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, path) AS rn FROM arrays) WHERE rn = 1 AND n > 0),
array_rows AS (SELECT e.doc_id, e.fullkey AS base, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY CAST(e.key AS INT)) - 1 AS INT) AS pos
  FROM best b JOIN nodes e ON e.doc_id = b.doc_id AND e.parent = b.id AND e.type = 'OBJECT'),
all_rows AS (SELECT * FROM root_rows UNION ALL SELECT * FROM array_rows),
record_cells AS (SELECT r.doc_id, r.pos AS row, substr(n.fullkey, length(r.base) + 2) AS k, {_TEXT} AS v
  FROM all_rows r JOIN nodes n ON n.doc_id = r.doc_id AND starts_with(n.fullkey, r.base || '.')
  WHERE NOT contains(substr(n.fullkey, length(r.base) + 2), '[') AND n.type <> 'OBJECT'),
kv AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY substr(fullkey, 3)) - 1 AS INT) AS row, substr(fullkey, 3) AS field, {_TEXT} AS value
  FROM nodes JOIN (SELECT doc_id FROM roots WHERE type = 'OBJECT') USING (doc_id)
  WHERE parent IS NOT NULL AND NOT contains(fullkey, '[') AND type <> 'OBJECT' AND doc_id NOT IN (SELECT doc_id FROM best)),
export_cells AS (SELECT doc_id, row, k, v FROM record_cells UNION ALL SELECT doc_id, row, 'field', field FROM kv UNION ALL SELECT doc_id, row, 'value', value FROM kv)"""


@query(
    "export_rows",
    f"WITH {_EXPORT} SELECT doc_id, row, string_agg(k || '=' || v, '|' ORDER BY k) AS cells FROM export_cells GROUP BY doc_id, row",
)
def export_rows(spark, sf):
    entries = F.array_sort(F.map_entries("cells"))
    return exports.rows(D.order_docs(spark, sf), "doc_id", "structured").select(
        "doc_id", "row",
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("cells"),
    )


@query("export_headers", f"WITH {_EXPORT} SELECT DISTINCT k AS header FROM export_cells")
def export_headers(spark, sf):
    return exports.headers(exports.rows(D.order_docs(spark, sf), "doc_id", "structured"))


@query(
    "export_table",
    f"""WITH {_EXPORT} SELECT doc_id, row, {', '.join(f"coalesce(max(v) FILTER (k = '{k}'), '') AS {n}" for k, n in
        (('id', 'id'), ('cust', 'cust'), ('status', 'status'), ('note', 'note'), ('n', 'n'), ('v', 'v'), ('field', 'field'), ('value', 'value')))}
FROM export_cells GROUP BY doc_id, row""",
)
def export_table(spark, sf):
    return exports.to_columns(exports.rows(D.order_docs(spark, sf), "doc_id", "structured"))


@query("largest_array", f"WITH {_EXPORT} SELECT doc_id, n, path FROM best")
def largest_array(spark, sf):
    found = let(
        jsontext.largest_array(F.col("v")),
        lambda a: F.when(a["n"] > 0, F.struct(a["n"].alias("n"), a["path"].alias("path"))),
    )
    return unfold_present(_parsed(spark, sf), ["doc_id"], found, "a").select("doc_id", "a.*")


def _as_text_sql(cell: str, sep: str, open_: str = "", close: str = "", rule: bool = False) -> str:
    line = f"'{open_}' || string_agg({{c}}, '{sep}' ORDER BY k) || '{close}'"
    ruled = f"""UNION ALL SELECT doc_id, -1, {line.format(c="'---'")} FROM heads GROUP BY doc_id""" if rule else ""
    return f"""WITH {_EXPORT},
heads AS (SELECT DISTINCT doc_id, k FROM export_cells),
grid AS (SELECT h.doc_id, r.row, h.k, coalesce(c.v, '') AS v FROM heads h JOIN (SELECT DISTINCT doc_id, row FROM export_cells) r USING (doc_id)
  LEFT JOIN export_cells c ON c.doc_id = h.doc_id AND c.row = r.row AND c.k = h.k),
lines AS (SELECT doc_id, -2 AS row, {line.format(c=cell.format(v='k'))} AS l FROM heads GROUP BY doc_id {ruled}
  UNION ALL SELECT doc_id, row, {line.format(c=cell.format(v='v'))} FROM grid GROUP BY doc_id, row),
texts AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY row) AS content FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(content, '{K.NO_TABULAR_DATA}') AS content FROM order_docs d LEFT JOIN texts USING (doc_id)"""


def _quoted_sql(sep: str) -> str:
    return f"""CASE WHEN regexp_matches({{v}}, '[{sep}"\\r\\n]') OR regexp_matches({{v}}, '^[ \\t]') THEN '"' || replace({{v}}, '"', '""') || '"' ELSE {{v}} END"""


def _exported(spark, sf, kind):
    return exports.documents_as(D.order_docs(spark, sf), "doc_id", "structured", kind, K.NO_TABULAR_DATA)


@query("export_csv", _as_text_sql(_quoted_sql(","), ","))
def export_csv(spark, sf):
    return _exported(spark, sf, "csv")


@query("export_tsv", _as_text_sql(_quoted_sql("\t"), "\t"))
def export_tsv(spark, sf):
    return _exported(spark, sf, "tsv")


@query("export_markdown", _as_text_sql("replace({v}, '|', '\\|')", " | ", "| ", " |", rule=True))
def export_markdown(spark, sf):
    return _exported(spark, sf, "markdown")


@query(
    "export_json",
    # Each value gives an opening line, containers a closing one as well, in the order of their places; '~' sorts behind all places within.
    f"""WITH RECURSIVE {_VALID},
walk AS (SELECT doc_id, 0 AS depth, '' AS place, '' AS label, '' AS tail, j AS v FROM valid
  UNION ALL SELECT doc_id, depth + 1, place || '/' || lpad(CAST(i AS VARCHAR), 6, '0'),
    CASE json_type(v) WHEN 'OBJECT' THEN CAST(to_json(ks[i]) AS VARCHAR) || ': ' ELSE '' END, CASE WHEN i < n THEN ',' ELSE '' END,
    CASE json_type(v) WHEN 'OBJECT' THEN json_extract(v, '$."' || ks[i] || '"') ELSE json_extract(v, '$[' || (i - 1) || ']') END
  FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS i FROM (SELECT *, list_sort(json_keys(v)) AS ks,
    CASE json_type(v) WHEN 'OBJECT' THEN len(json_keys(v)) WHEN 'ARRAY' THEN json_array_length(v) ELSE 0 END AS n FROM walk))),
sized AS (SELECT *, repeat('  ', depth) AS pad, CASE json_type(v) WHEN 'OBJECT' THEN '{{}}' WHEN 'ARRAY' THEN '[]' ELSE '' END AS ends,
  CASE json_type(v) WHEN 'OBJECT' THEN len(json_keys(v)) > 0 WHEN 'ARRAY' THEN json_array_length(v) > 0 ELSE FALSE END AS opens FROM walk),
lines AS (SELECT doc_id, place, pad || label || CASE WHEN opens THEN ends[1] ELSE CAST(v AS VARCHAR) || tail END AS l FROM sized
  UNION ALL SELECT doc_id, place || '~', pad || ends[2] || tail FROM sized WHERE opens),
texts AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY place) AS content FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(content, structured) AS content FROM order_docs d LEFT JOIN texts USING (doc_id)""",
)
def export_json(spark, sf):
    return _exported(spark, sf, "json")


@query(
    "export_schema",
    f"""WITH {D.CSV_CELLS_SQL},
kinds AS (SELECT *, CASE WHEN lower(value) IN {D.MISSING_SQL} THEN NULL ELSE {D.classify_sql('value')} END AS kind FROM csv_cells),
fields AS (SELECT doc_id, position, name, CASE count(DISTINCT kind) WHEN 0 THEN 'null' WHEN 1 THEN min(kind) ELSE 'mixed' END AS type,
    count(*) AS n_rows, count(CASE WHEN value = '' THEN 1 END) AS gone, count(DISTINCT value) FILTER (value <> '') AS n_distinct,
    coalesce((list(value ORDER BY n) FILTER (value <> ''))[1:3], []) AS samples FROM kinds GROUP BY doc_id, position, name),
issues AS (SELECT doc_id, list(issue ORDER BY o) AS issues FROM (
  SELECT doc_id, position * 2 AS o, name || ': ' || gone || ' empty values (' || (gone * 100 // n_rows) || '%)' AS issue FROM fields WHERE gone > 0
  UNION ALL SELECT doc_id, position * 2 + 1, name || ': {K.ISSUE_MIXED}' FROM fields WHERE type = 'mixed') GROUP BY doc_id),
docs AS (SELECT doc_id, max(n_rows) AS row_count, count(*) AS field_count, list(struct_pack(name := name, type := type, nullable := gone > 0,
    "unique" := n_distinct = n_rows - gone AND n_distinct > 0, empty_count := gone, missing_count := gone, sample_values := samples) ORDER BY position) AS fields
  FROM fields GROUP BY doc_id)
SELECT doc_id, CAST(to_json(struct_pack(doc_type := 'csv', row_count := row_count, field_count := field_count, fields := fields,
  issues := coalesce(issues, []))) AS VARCHAR) AS schema_json FROM docs LEFT JOIN issues USING (doc_id)""",
)
def export_schema(spark, sf):
    docs = with_profile(D.csv_docs(spark, sf), "text")
    return docs.select("doc_id", F.to_json(schema_struct()).alias("schema_json"))


@query(
    "before_after",
    f"""WITH {D.ORDER_DOCS_SQL} SELECT doc_id, raw, structured, length(raw) AS raw_chars, length(structured) AS structured_chars FROM order_docs""",
)
def before_after(spark, sf):
    return D.order_docs(spark, sf).select(
        "doc_id", "raw", "structured", F.length("raw").alias("raw_chars"),
        F.length("structured").alias("structured_chars"),
    )
