"""Schema inference and clean reports.

A document is one row, so its profile is one projection: no shuffle, whatever the number of
documents. A whole table profiled as one document is the opposite case and takes the shuffle form,
``profile_table``, which groups by (field, value) with map-side combining before anything wider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import csvtext, jsontext
from quillgrid.functions.core import compact_texts, let, percent, unfold
from quillgrid.functions.text import classify_value, collapse_types, currency_cells, doc_type, is_missing
from quillgrid.operators.quantiles import fences

FIELD = (
    "struct<name:string,type:string,nullable:boolean,`unique`:boolean,empty_count:int,"
    "missing_count:int,sample_values:array<string>>"
)


def _field(name, kind, nullable, unique, empty, missing, samples) -> Column:
    return F.struct(
        name.alias("name"), kind.alias("type"), nullable.alias("nullable"), unique.alias("unique"),
        empty.cast("int").alias("empty_count"), missing.cast("int").alias("missing_count"),
        samples.alias("sample_values"),
    )


def value_types(values: Column) -> Column:
    """Distinct semantic types of values that are present."""
    return F.array_distinct(F.transform(F.filter(values, lambda v: ~is_missing(v)), classify_value))


def _csv_fields(records: Column) -> Column:
    """Field profiles of delimited records; types look at distinct values only."""
    header = F.get(records, F.lit(0))
    rows = F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(0)))

    def cells(rows_: Column, i: Column) -> Column:
        return F.transform(rows_, lambda r: F.coalesce(F.get(r, i), F.lit("")))

    def profile(s: Column) -> Column:
        present, distinct = s["present"], s["distinct"]
        empty = s["total"] - F.size(present)
        return _field(
            s["name"], collapse_types(value_types(distinct)), empty > 0,
            (F.size(distinct) == F.size(present)) & (F.size(distinct) > 0),
            empty, empty, F.slice(present, 1, 3),
        )

    def column(name: Column, i: Column, rows_: Column) -> Column:
        label = F.when(name == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(name)
        shown = F.filter(cells(rows_, i), lambda v: v != "")
        parts = let(
            shown,
            lambda p: F.struct(
                label.alias("name"), p.alias("present"), F.array_distinct(p).alias("distinct"),
                F.size(rows_).alias("total"),
            ),
        )
        return let(parts, profile)

    return let(rows, lambda rows_: F.transform(header, lambda name, i: column(name, i, rows_)))


def _csv_issues(records: Column, fields: Column, ragged: Column) -> Column:
    header = F.get(records, F.lit(0))
    n_rows = F.size(records) - 1

    def of(f: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return compact_texts(
            F.when(F.get(header, i) == "", F.concat(F.lit("Column "), number, F.lit(" has no header name"))),
            F.when(
                f["empty_count"] > 0,
                F.concat(
                    f["name"], F.lit(": "), f["empty_count"].cast("string"), F.lit(" empty values ("),
                    percent(f["empty_count"], n_rows).cast("string"), F.lit("%)"),
                ),
            ),
            F.when(f["type"] == "mixed", F.concat(f["name"], F.lit(": " + K.ISSUE_MIXED))),
        )

    uneven = F.when(
        ragged > 0, F.concat(ragged.cast("string"), F.lit(" rows differ from the header in field count"))
    )
    return F.concat(F.flatten(F.transform(fields, of)), compact_texts(uneven))


def _json_fields(rows: Column) -> Column:
    """Field profiles over records; explicit nulls are empties, absent keys are counted apart.

    References to members are sorted by key, so each field is one run of them. The work is near
    linear in the number of members, also where records have very many different keys.
    """
    refs = F.array_sort(
        F.flatten(
            F.transform(
                rows,
                lambda r, i: F.transform(F.map_keys(r), lambda k: F.struct(k.alias("key"), i.alias("row"))),
            )
        )
    )

    def of_refs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"))),
            lambda e: (e["at"] == 0) | (F.get(s, e["at"] - 1)["key"] != e["key"]),
        )

        def field(name: Column, run: Column) -> Column:
            values = F.transform(run, lambda x: F.try_element_at(F.get(rows, x["row"]), x["key"]))

            def of(vals: Column) -> Column:
                shown = F.filter(vals, lambda v: ~F.is_variant_null(v))
                empty = F.size(vals) - F.size(shown)
                return _field(
                    name, collapse_types(F.array_distinct(F.transform(vals, jsontext.field_type))),
                    empty > 0, F.lit(False), empty, F.size(rows) - F.size(vals),
                    F.transform(F.slice(shown, 1, 3), lambda v: F.to_json(v)),
                )

            return let(values, of)

        def of_starts(st: Column) -> Column:
            return F.transform(
                st,
                lambda e, j: field(
                    e["key"], F.slice(s, e["at"] + 1, F.coalesce(F.get(st, j + 1)["at"], F.size(s)) - e["at"])
                ),
            )

        return let(starts, of_starts)

    return let(refs, of_refs)


def _object_fields(members: Column, sample_length: int | None = None) -> Column:
    """Fields of a single object, with its value as a sample; one of more characters than a given length is shortened."""
    def field(name: Column) -> Column:
        def of(v: Column) -> Column:
            sample = text = F.to_json(v)
            if sample_length is not None:
                shown = F.concat(F.left(text, F.lit(sample_length)), F.lit("..."))
                sample = F.when(F.length(text) > sample_length, shown).otherwise(text)
            return _field(
                name, jsontext.field_type(v), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.array(sample)
            )

        return let(F.try_element_at(members, name), of)

    return F.transform(F.array_sort(F.map_keys(members)), field)


def with_profile(df: DataFrame, text: str, strict: bool = False, sample_length: int | None = None) -> DataFrame:
    """Adds ``doc_type, row_count, field_count, fields, issues``.

    The samples of a single object are whole unless ``sample_length`` is given.

    ``strict`` rejects a delimited text whose lines differ in field count; otherwise such lines are
    repaired where possible, cut or padded to the header, and reported.
    """
    no_fields = F.array().cast(f"array<{FIELD}>")
    typed = df.withColumn("doc_type", doc_type(F.col(text)))
    parsed = typed.withColumn(
        "_csv", F.when(F.col("doc_type") == K.CSV, csvtext.records(F.col(text), repair=not strict))
    ).withColumn("_json", F.when(F.col("doc_type") == K.JSON, jsontext.strict(F.col(text))))
    parsed = parsed.withColumn("_rows", jsontext.record_array(F.col("_json"))).withColumn(
        "_object", jsontext.as_object(F.col("_json"))
    )
    width = F.size(F.get(F.col("_csv"), F.lit(0)))
    ragged = F.size(F.filter(F.col("_csv"), lambda r: F.size(r) != F.size(F.get(F.col("_csv"), F.lit(0)))))
    counted = parsed.withColumn("_ragged", F.coalesce(ragged, F.lit(0)))
    csv_ok = (F.col("doc_type") == K.CSV) & (F.size("_csv") >= 2)
    if strict:
        csv_ok = csv_ok & (F.col("_ragged") == 0)
    rows_ok = F.coalesce(F.size("_rows") > 0, F.lit(False))
    counted = counted.withColumn("_csv_ok", csv_ok).withColumn("_rows_ok", rows_ok)
    fields = (
        F.when(F.col("_csv_ok"), _csv_fields(F.col("_csv")))
        .when(F.col("_rows_ok"), _json_fields(F.col("_rows")))
        .when(F.col("_object").isNotNull(), _object_fields(F.col("_object"), sample_length))
        .otherwise(no_fields)
    )
    with_fields = counted.withColumn("fields", fields)
    issues = (
        F.when(F.col("_csv_ok"), _csv_issues(F.col("_csv"), F.col("fields"), F.col("_ragged")))
        .when(F.col("doc_type") == K.CSV, F.array(F.lit(K.ISSUE_BAD_CSV)))
        .when(F.col("_rows_ok") | F.col("_object").isNotNull(), F.array().cast("array<string>"))
        .when(F.col("doc_type") == K.JSON, F.array(F.lit(K.ISSUE_BAD_JSON)))
        .otherwise(F.array(F.lit(K.ISSUE_NO_SCHEMA)))
    )
    row_count = (
        F.when(F.col("_csv_ok"), F.size("_csv") - 1)
        .when(F.col("_rows_ok"), F.size("_rows"))
        .when(F.col("_object").isNotNull(), 1)
        .otherwise(0)
    )
    field_count = F.when(F.col("_csv_ok"), width).otherwise(F.size("fields"))
    return (
        with_fields.withColumn("row_count", row_count)
        .withColumn("field_count", field_count)
        .withColumn("issues", issues)
        .drop("_csv", "_json", "_rows", "_object", "_ragged", "_csv_ok", "_rows_ok")
    )


def profile_fields(profiled: DataFrame, key: str) -> DataFrame:
    """One row per (document, field) of a profiled DataFrame."""
    return unfold(profiled, [key], F.col("fields"), "position", "f").select(key, "position", "f.*")


def schema_struct() -> Column:
    """The inferred schema of a profiled DataFrame as one struct, for export."""
    return F.struct("doc_type", "row_count", "field_count", "fields", "issues")


def with_clean_report(profiled: DataFrame, text: str) -> DataFrame:
    """Adds ``clean``: counts over the fields, currency cells in the raw text, and advice."""
    def total(pred, value=None) -> Column:
        chosen = F.filter(F.col("fields"), pred)
        if value is None:
            return F.size(chosen)
        return F.aggregate(F.transform(chosen, value), F.lit(0), lambda a, x: a + x)

    everything = lambda f: F.lit(True)
    counts = (
        profiled.withColumn("_total", F.col("row_count") * F.size("fields"))
        .withColumn("_empty", total(everything, lambda f: f["empty_count"]))
        .withColumn("_currency", currency_cells(F.col(text)))
        .withColumn("_dates", total(lambda f: f["type"] == "date"))
        .withColumn(
            "_emails", total(lambda f: f["type"] == "email", lambda f: F.col("row_count") - f["empty_count"])
        )
        .withColumn(
            "_mixed",
            F.transform(F.filter(F.col("fields"), lambda f: f["type"] == "mixed"), lambda f: f["name"]),
        )
    )
    share = percent(F.col("_empty"), F.greatest(F.col("_total"), F.lit(1))).cast("string")
    advice = compact_texts(
        F.when(F.col("_empty") > 0, F.concat(F.lit("Data has "), share, F.lit(K.ADVICE_MISSING))),
        F.when(
            F.size("_mixed") > 0,
            F.concat(F.lit("Columns with mixed types: "), F.array_join("_mixed", ", "), F.lit(K.ADVICE_MIXED)),
        ),
        F.when(F.col("_currency") > 0, F.lit(K.ADVICE_CURRENCY)),
        F.when(F.col("_dates") > 1, F.lit(K.ADVICE_DATES)),
    )
    clean = F.struct(
        F.col("_total").alias("total_values"), F.col("_empty").alias("empty_values"),
        F.col("_currency").alias("currency_values"), F.col("_dates").alias("date_columns"),
        F.col("_emails").alias("email_values"), F.col("_mixed").alias("mixed_type_columns"),
        advice.alias("suggestions"),
    )
    return counts.withColumn("clean", clean).drop(
        "_total", "_empty", "_currency", "_dates", "_emails", "_mixed"
    )


# --- whole tables -----------------------------------------------------------------------------


def cells_of(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Long form ``(field, value, row_key)`` of a table, values as trimmed text."""
    texts = df.select(
        F.col(order).alias("row_key"),
        *[F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns],
    )
    return texts.unpivot("row_key", columns, "field", "value")


def value_counts(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``(field, value, n, first_key)``: the level both the profile and its samples start from.

    Partial aggregation collapses repeats before the shuffle, and the shuffle key holds the value,
    so one field or one frequent value never lands whole in a task.
    """
    return cells_of(df, order, columns).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first_key")
    )


def profile_values(counts: DataFrame) -> DataFrame:
    """Field profiles from value counts: every distinct value is classified once."""
    shown = F.col("value") != ""
    typed = counts.withColumn("kind", F.when(~is_missing(F.col("value")), classify_value(F.col("value"))))
    return (
        typed.groupBy("field")
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(~shown, F.col("n"))), F.lit(0)).alias("empty_count"),
            F.count(F.when(shown, 1)).alias("distinct_count"),
            F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("shown"),
            F.array_sort(F.collect_set("kind")).alias("kinds"),
        )
        .select(
            "field", "row_count", "empty_count", "distinct_count",
            collapse_types(F.col("kinds")).alias("type"),
            (F.col("empty_count") > 0).alias("nullable"),
            ((F.col("distinct_count") == F.col("shown")) & (F.col("distinct_count") > 0)).alias("unique"),
        )
    )


def first_values(cells: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` values of each field in row order, empty ones left out and repeats kept; ``cells`` as of ``cells_of``.

    The rank filter becomes a window group limit: each task keeps ``n`` rows per field before the
    shuffle, so a field with very many values stays cheap.
    """
    order = Window.partitionBy("field").orderBy("row_key", "value")
    return (
        cells.where(F.col("value") != "")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("field", "rank", "value")
    )


def enums_and_keys(profile: DataFrame, limit: int = 10) -> DataFrame:
    """Fields with few distinct values, and fields that could be a key."""
    return profile.select(
        "field", "distinct_count",
        ((F.col("distinct_count") > 0) & (F.col("distinct_count") < limit)).alias("is_enum"),
        (F.col("unique") & ~F.col("nullable")).alias("is_key"),
    )


def references(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row telling whether every child value exists in the parent, whose key must be unique.

    Both sides shrink to distinct values before they meet, so frequent keys do not skew the join.
    """
    have = parent.groupBy(F.col(parent_key).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    want = child.select(F.col(child_key).alias("v")).where(F.col("v").isNotNull()).distinct()
    return (
        want.join(have, "v", "left")
        .agg(
            F.count(F.lit(1)).alias("child_values"),
            F.count_if(F.col("n").isNull()).alias("orphans"),
            F.count_if(F.col("n") > 1).alias("ambiguous"),
        )
        .select(
            F.lit(child_key).alias("child"), F.lit(parent_key).alias("parent"),
            "child_values", "orphans",
            ((F.col("orphans") == 0) & (F.col("ambiguous") == 0)).alias("references"),
        )
    )


def outliers(df: DataFrame, key: str, columns: list[str], factor: float = 1.5) -> DataFrame:
    """``row_key, field, value, low, high``: values outside the interquartile fences of each numeric column."""
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    cells = unfold(df, [F.col(key).alias("row_key")], values, "_i", "c").select("row_key", "c.*")
    # One row for each named column.
    bounds = F.broadcast(fences(df, columns, factor).select("field", "low", "high"))
    return cells.join(bounds, "field").where("value < low OR value > high").select("row_key", "field", "value", "low", "high")


def typed_facts(counts: DataFrame) -> DataFrame:
    """``field, n, low, high, mean, first_day, last_day``: what a field's numbers and dates tell, from value counts.

    Which values are numbers or dates is found by their form, so no column is named; values that are neither, or missing, don't count.
    Every distinct value is read once, weighted by its count.
    """
    kind = classify_value(F.col("value"))
    bare = F.regexp_replace(F.regexp_replace("value", r"^[$€£]", ""), ",", "")
    typed = counts.where(~is_missing(F.col("value"))).select(
        "field", "n", F.when(kind == "number", bare.try_cast("double")).alias("v"),
        F.when(kind == "date", F.left("value", F.lit(10)).try_cast("date")).alias("day"))
    return typed.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        (F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def top_value(counts: DataFrame) -> DataFrame:
    """Most frequent non-empty value of each field; ties go to the smallest value."""
    shown = counts.where(F.col("value") != "")
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return (
        shown.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == 1)
        .select("field", F.col("value").alias("top_value"), F.col("n").alias("top_count"))
    )
