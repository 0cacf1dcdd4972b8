"""Queries over forms of values, clusters and learned aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import forms, profile
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.session import materialise
from quillgrid.sources.files import table

#: Cells as people type them, from the customers' own values. Expressions are valid in both languages.
_TYPED = {
    "segment": """CASE WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 1 THEN c_mktsegment || '.'
      WHEN c_custkey % 23 = 2 THEN substring(c_mktsegment, 1, 3) || substring(c_mktsegment, 5, 20)
      WHEN c_custkey % 23 = 3 THEN substring(c_mktsegment, 1, 2) || substring(c_mktsegment, 4, 1) || substring(c_mktsegment, 3, 1) || substring(c_mktsegment, 5, 20)
      WHEN c_custkey % 23 = 4 THEN c_mktsegment || 'S' WHEN c_custkey % 29 = 5 THEN 'N/A' ELSE c_mktsegment END""",
    "place": """CASE c_custkey % 9 WHEN 0 THEN 'Lower Valley' WHEN 1 THEN 'valley, lower' WHEN 2 THEN 'LV' WHEN 3 THEN 'Long Vale' WHEN 4 THEN 'Lowr Valley'
      WHEN 5 THEN '' ELSE 'Lower Valley' END""",
    "paid": """CASE c_custkey % 5 WHEN 0 THEN '$' || CAST(c_custkey AS STRING) || ',000' WHEN 1 THEN CAST(c_custkey AS STRING) || '.50' WHEN 2 THEN 'null'
      WHEN 3 THEN CAST(-c_custkey AS STRING) ELSE 'two' END""",
    "day": """CASE c_custkey % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') WHEN 1 THEN '05/' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/2024'
      WHEN 2 THEN 'soon' ELSE '03-Feb-2023' END""",
}
_COUNTS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, trim({e}) AS value FROM customer" for c, e in _TYPED.items()) + """),
every AS (SELECT field, value, count(*) AS n FROM cells GROUP BY ALL),
counts AS (SELECT * FROM every WHERE lower(value) NOT IN """ + D.MISSING_SQL + ")"


def _typed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *[F.expr(e).alias(c) for c, e in _TYPED.items()])


def _counts(spark, sf):
    return materialise(profile.value_counts(_typed(spark, sf), "c_custkey", list(_TYPED)), "counts")


_FORM_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '[0-9]+', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]+', 'a', 'g'), '\\s+', ' ', 'g')"""


@query("value_forms", f"WITH {_COUNTS_SQL} SELECT field, {_FORM_SQL} AS form, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values FROM counts GROUP BY ALL")
def value_forms(spark, sf):
    return forms.forms(_counts(spark, sf)).withColumnRenamed("values", "n_values")


_DAY_FORMS = {"YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$", "MM/DD/YYYY": r"^\d{2}/\d{2}/\d{4}$", "DD-Mon-YYYY": r"^\d{2}-[A-Za-z]{3}-\d{4}$"}
_DAY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{n}'" for n, p in _DAY_FORMS.items()) + " END"


@query(
    "column_quality",
    f"""WITH {_COUNTS_SQL}, told AS (SELECT field, n, lower(value) IN {D.MISSING_SQL} AS absent,
  CASE WHEN regexp_matches(replace(replace(value, '$', ''), ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN {_FORM_SQL} END AS num, {_DAY_SQL} AS day FROM every)
SELECT field, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (absent), 0) AS BIGINT) AS missing,
  CAST(coalesce(sum(n) FILTER (num IS NOT NULL), 0) AS BIGINT) AS numbers, CAST(coalesce(sum(n) FILTER (day IS NOT NULL), 0) AS BIGINT) AS dates,
  coalesce(string_agg(DISTINCT num, ' | ' ORDER BY num), '') AS number_forms, coalesce(string_agg(DISTINCT day, ' | ' ORDER BY day), '') AS date_forms
FROM told GROUP BY field""",
)
def column_quality(spark, sf):
    """A quality summary that names no column."""
    out = forms.column_quality(_counts(spark, sf))
    return out.select("field", "total", "missing", "numbers", "dates", *[F.array_join(c, " | ").alias(c) for c in ("number_forms", "date_forms")])


# All pairs of clusters, compared one by one.
_ALIASES_SQL = f"""{_COUNTS_SQL},
raw_keys AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(
  string_split_regex(regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+'), lambda w: w <> ''))), ' ') AS k FROM counts),
keyed AS (SELECT field, value, n, CASE WHEN regexp_matches(k, '\\p{{L}}') THEN k ELSE value END AS key FROM raw_keys),
heads AS (SELECT field, key, sum(n) AS total, first(value ORDER BY n DESC, value) AS canonical FROM keyed GROUP BY ALL),
spelled AS (SELECT a.field, a.key, first(b.key ORDER BY b.total DESC, b.key) AS near FROM heads a JOIN heads b
  ON a.field = b.field AND damerau_levenshtein(a.key, b.key) = 1 AND b.total >= 3 * a.total AND length(a.key) >= 5 AND length(b.key) >= 5
  AND regexp_matches(a.key, '\\p{{L}}') AND regexp_matches(b.key, '\\p{{L}}') GROUP BY ALL),
worded AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(canonical), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM heads),
longs AS (SELECT field, array_to_string(list_transform(ws, lambda w: w[1]), '') AS short, key, total FROM worded WHERE len(ws) BETWEEN 2 AND 5),
best AS (SELECT field, short, first(key ORDER BY total DESC, key) AS near, max(total) AS top, sum(total) AS whole FROM longs GROUP BY ALL),
short_for AS (SELECT h.field, h.key, near FROM heads h JOIN best b ON b.field = h.field AND b.short = h.key WHERE regexp_matches(h.key, '^\\p{{L}}{{2,5}}$') AND top >= (whole - top) * 3),
targets AS (SELECT field, key, near, 'initials' AS reason FROM short_for
  UNION ALL SELECT field, key, near, 'spelling' FROM spelled s WHERE NOT EXISTS (SELECT 1 FROM short_for f WHERE f.field = s.field AND f.key = s.key)),
aliases AS (
  SELECT k.field, k.value, coalesce(o.canonical, h.canonical) AS alias, k.n, coalesce(t.reason, 'writing') AS reason
  FROM keyed k JOIN heads h ON h.field = k.field AND h.key = k.key LEFT JOIN targets t ON t.field = k.field AND t.key = k.key
    LEFT JOIN heads o ON o.field = t.field AND o.key = t.near
  WHERE coalesce(o.canonical, h.canonical) <> k.value)"""


@query("learned_aliases", f"WITH {_ALIASES_SQL} SELECT field, value, alias, n, reason FROM aliases")
def learned_aliases(spark, sf):
    return forms.learned_aliases(_counts(spark, sf))


@query(
    "counts_by_alias",
    f"""WITH {_ALIASES_SQL}, rows AS (SELECT trim({_TYPED['segment']}) AS segment, trim({_TYPED['place']}) AS place FROM customer)
SELECT coalesce(a.alias, segment) AS segment, coalesce(b.alias, place) AS place, count(*) AS n FROM rows
  LEFT JOIN aliases a ON a.field = 'segment' AND a.value = segment LEFT JOIN aliases b ON b.field = 'place' AND b.value = place GROUP BY 1, 2""",
)
def counts_by_alias(spark, sf):
    """A summary in which what means the same counts together."""
    aliases = materialise(forms.learned_aliases(_counts(spark, sf)), "aliases")
    rows = forms.with_aliases(_typed(spark, sf).select("segment", "place"), ["segment", "place"], aliases)
    return rows.groupBy("segment", "place").agg(F.count(F.lit(1)).alias("n"))
