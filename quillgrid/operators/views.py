"""Which views suit a document, and the data of charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions import jsontext
from quillgrid.functions.core import let, lines_of, occurrences
from quillgrid.session import materialise

_NO_CHARTS = "array<string>"


def has_tabs(text: Column) -> Column:
    """At least three lines with at least two tabs."""
    return F.size(F.filter(lines_of(text), lambda l: occurrences(l, "\t") >= 2)) >= 3


def has_tabular_json(value: Column) -> Column:
    """A non-empty array, or an object with an array of more than one item."""
    items, members = jsontext.as_array(value), jsontext.as_object(value)
    nested = F.exists(F.map_values(members), lambda v: F.size(jsontext.as_array(v)) > 1)
    return F.coalesce(F.size(items) > 0, F.lit(False)) | F.coalesce(nested, F.lit(False))


def chart_list(numeric: Column, categorical: Column, dated: Column) -> Column:
    """Chart types for the kinds of fields present; empty without a numeric field."""
    none = F.array().cast(_NO_CHARTS)
    categories = F.when(categorical, F.array(F.lit("bar"), F.lit("pie"))).otherwise(none)
    times = F.when(dated, F.array(F.lit("line"))).otherwise(none)
    return F.when(~numeric, none).when(
        ~categorical & ~dated, F.array(F.lit("bar"))
    ).otherwise(F.concat(categories, times))


def _kinds_of_records(value: Column) -> Column:
    """``struct<numeric, categorical>`` of the first record: of the array itself, else of any member."""
    def kinds(records: Column) -> Column:
        values = F.flatten(F.transform(records, F.map_values))
        found = F.transform(values, jsontext.kind)
        return let(
            found,
            lambda f: F.struct(
                F.array_contains(f, "number").alias("numeric"), F.array_contains(f, "string").alias("categorical"),
            ),
        )

    own = jsontext.record_array(value)
    members = F.coalesce(
        F.map_values(jsontext.as_object(value)), F.array().cast("array<variant>")
    )
    nested = F.transform(
        F.filter(F.transform(members, jsontext.record_array), lambda r: F.size(r) > 0),
        lambda r: F.get(r, F.lit(0)),
    )
    firsts = let(own, lambda r: F.when(F.size(r) > 0, F.slice(r, 1, 1)).otherwise(nested))
    return let(firsts, kinds)


def chart_types(structured: Column, schema: Column) -> Column:
    """Chart types from the stored schema; without a numeric field there, from the first record.

    ``structured`` and ``schema`` are parsed values.
    """
    fields = jsontext.as_array(F.try_variant_get(schema, "$.fields", "variant"))
    named = F.coalesce(
        F.transform(fields, lambda f: F.try_variant_get(f, "$.type", "string")), F.array().cast(_NO_CHARTS)
    )

    def decide(s: Column) -> Column:
        has = lambda t: F.array_contains(s["named"], t)
        from_rows = let(
            _kinds_of_records(structured),
            lambda r: chart_list(r["numeric"], r["categorical"] | has("string"), has("date")),
        )
        return F.when(has("number"), chart_list(F.lit(True), has("string"), has("date"))).otherwise(from_rows)

    return F.when(
        structured.isNotNull() | schema.isNotNull(), let(F.struct(named.alias("named")), decide)
    ).otherwise(F.array().cast(_NO_CHARTS))


def chart_types_raw(text: Column, kind: Column, fields: Column) -> Column:
    """Chart types before parsing: from the delimited profile, else from lines with numbers."""
    types = F.transform(fields, lambda f: f["type"])
    from_profile = let(
        types,
        lambda t: chart_list(
            F.array_contains(t, "number"), F.array_contains(t, "string"), F.array_contains(t, "date")
        ),
    )
    lines_with_numbers = F.size(F.filter(lines_of(text), lambda l: l.rlike(K.CHART_NUMBER)))
    from_lines = F.when(lines_with_numbers >= 3, F.array(F.lit("bar"))).otherwise(F.array().cast(_NO_CHARTS))
    numeric_profile = (kind == K.CSV) & F.exists(fields, lambda f: f["type"] == "number")
    return F.when(numeric_profile, from_profile).otherwise(from_lines)


def _view(enabled: Column | bool, reason: Column, charts: Column | None = None) -> Column:
    return F.struct(
        (enabled if isinstance(enabled, Column) else F.lit(enabled)).alias("enabled"),
        reason.alias("reason"),
        (charts if charts is not None else F.array().cast(_NO_CHARTS)).alias("chart_types"),
    )


def with_views(
    profiled: DataFrame, text: str, structured: str, schema: str, collection_size: str, to: str = "views"
) -> DataFrame:
    """Adds ``map<view, struct<enabled, reason, chart_types>>``.

    ``profiled`` carries ``doc_type`` and ``fields`` of the raw text. A NULL text means that the
    session has no document.
    """
    say = lambda name: F.lit(K.VIEW_REASONS[name])
    has_doc = F.col(text).isNotNull()
    parsed = profiled.withColumn("_s", jsontext.strict(F.col(structured))).withColumn(
        "_c", jsontext.strict(F.col(schema))
    )
    from_json = F.when(
        F.coalesce(F.col(structured), F.lit("")) != "", chart_types(F.col("_s"), F.col("_c"))
    ).otherwise(F.array().cast(_NO_CHARTS))
    with_charts = parsed.withColumn("_json_charts", from_json).withColumn(
        "_charts",
        F.when(F.size("_json_charts") > 0, F.col("_json_charts")).otherwise(
            chart_types_raw(F.coalesce(F.col(text), F.lit("")), F.col("doc_type"), F.col("fields"))
        ),
    )
    tabular = (F.col("doc_type") == K.CSV) | has_tabular_json(F.col("_s")) | has_tabs(F.col(text))
    tabular = F.coalesce(tabular, F.lit(False))
    charted = F.size("_charts") > 0
    size = F.coalesce(F.col(collection_size), F.lit(0))
    uploaded = F.when(has_doc, say("uploaded")).otherwise(say("upload_first"))
    views = F.create_map(
        F.lit("explorer"), _view(True, say("explorer")),
        F.lit("summary"), _view(has_doc, uploaded),
        F.lit("schema"), _view(has_doc, uploaded),
        F.lit("table"), _view(
            has_doc & tabular,
            F.when(~has_doc, say("upload_first")).when(tabular, say("tabular")).otherwise(say("not_tabular")),
        ),
        F.lit("graphs"), _view(
            has_doc & charted,
            F.when(~has_doc, say("upload_first")).when(charted, say("numeric")).otherwise(say("not_numeric")),
            F.when(has_doc, F.col("_charts")).otherwise(F.array().cast(_NO_CHARTS)),
        ),
        F.lit("oracle"), _view(
            has_doc & (size > 0),
            F.when(~has_doc, say("upload_and_collect")).when(size >= 2, say("many_documents"))
            .when(size == 1, say("one_document")).otherwise(say("no_documents")),
        ),
    )
    return with_charts.withColumn(to, views).drop("_s", "_c", "_json_charts", "_charts")


# --- chart data -------------------------------------------------------------------------------


def bar_data(df: DataFrame, label: Column, value: Column, n: int) -> DataFrame:
    """Sum per label, the ``n`` largest; a distributed top-n, not a full sort."""
    return (
        df.groupBy(label.alias("label")).agg(F.sum(value).alias("value"))
        .orderBy(F.desc("value"), "label").limit(n)
    )


def pie_data(df: DataFrame, label: Column, value: Column, slices: int = K.PIE_SLICES) -> DataFrame:
    """Share per label; labels beyond the largest ``slices`` merge into one.

    The sums are written once and read for the total, the largest labels and the merge. The kept
    labels are at most ``slices`` rows, the bound that allows broadcasting them.
    """
    sums = materialise(df.groupBy(label.alias("label")).agg(F.sum(value).alias("value")), "pie")
    kept = sums.orderBy(F.desc("value"), "label").limit(slices).select(F.col("label").alias("kept"))
    total = sums.agg(F.sum("value")).scalar()
    merged = (
        sums.join(F.broadcast(kept), F.col("label") == F.col("kept"), "left")
        .groupBy(F.coalesce("kept", F.lit(K.OTHER_LABEL)).alias("label"))
        .agg(F.sum("value").alias("value"))
    )
    return merged.withColumn("percent", F.round(F.try_divide(F.col("value") * 100, total), 1))


def line_data(df: DataFrame, ts: Column, value: Column, unit: str = "month") -> DataFrame:
    """Sum per time unit, in time order."""
    return (
        df.groupBy(F.date_trunc(unit, ts).alias("at")).agg(F.sum(value).alias("value")).orderBy("at")
    )


def chart_spec(data: DataFrame, kind: str, title: str, series: str, order: list[Column]) -> DataFrame:
    """One row with the chart as JSON.

    ``data`` is chart data of at most a few dozen points, bounded by its own limit.
    """
    if kind not in ("bar", "pie", "line"):
        raise ValueError(f"unknown chart type: {kind}")
    placed = data.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    points = F.array_sort(F.collect_list(F.struct("_n", "label", "value")))
    return placed.agg(points.alias("p")).select(
        F.to_json(
            F.struct(
                F.lit(kind).alias("type"), F.lit(title).alias("title"),
                F.transform("p", lambda x: x["label"]).alias("labels"),
                F.array(
                    F.struct(
                        F.lit(series).alias("label"), F.transform("p", lambda x: x["value"]).alias("data")
                    )
                ).alias("datasets"),
            )
        ).alias("chart")
    )


def axis_label(value: Column) -> Column:
    """``1.2k`` from a thousand, ``12k`` from ten thousand, whole numbers below.

    Rounded as C does: by the exact value of the double, halves to even. ``format_string`` alone rounds the shortest decimal, halves up.
    """
    def whole(v: Column) -> Column:
        return F.format_string("%.0f", F.rint(v))

    def tenths(v: Column) -> Column:
        # Below 10.0 a double from 1.0 on is a whole number of 2^-52, and ten times that number fits a long.
        units = (v * F.lit(2.0**52)).cast("bigint") * 10
        down, rest = F.shiftright(units, 52), units.bitwiseAND(F.lit(2**52 - 1))
        up = (rest > 2**51) | ((rest == 2**51) & (down % 2 == 1))
        return let(down + up.cast("bigint"), lambda t: F.format_string("%d.%dk", F.floor(t / 10), t % 10))

    return (
        F.when(value >= 10000, F.concat(whole(value / 1000), F.lit("k")))
        .when(value >= 1000, tenths(value / 1000))
        .otherwise(whole(value))
    )


def axis_ticks(top: Column, steps: int = K.AXIS_STEPS) -> Column:
    """``array<struct<step, value, label>>``: evenly spaced ticks from the top to zero."""
    top = F.greatest(top.cast("double"), F.lit(1.0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: let(
            top / steps * (F.lit(steps) - i),
            lambda v: F.struct(i.alias("step"), v.alias("value"), axis_label(v).alias("label")),
        ),
    )
