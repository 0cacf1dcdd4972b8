"""Structured JSON to tables: records, headers, and file formats."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import jsontext
from quillgrid.functions.core import let, unfold
from quillgrid.functions.text import file_stem
from quillgrid.session import materialise

FORMATS = {"json": ".json", "csv": ".csv", "tsv": ".tsv", "markdown": ".md"}
_ROWS = "array<map<string,string>>"


def record_maps(value: Column) -> Column:
    """``array<map<string,string>>``: the rows a JSON value exports to.

    An array of records gives its records; an object gives its largest array of records, or one
    ``field, value`` row per leaf when it has none.
    """
    def flat(items: Column) -> Column:
        return F.transform(items, jsontext.flat_map)

    def key_values(obj: Column) -> Column:
        entries = F.sort_array(F.map_entries(jsontext.flat_map(obj)))
        return F.transform(
            entries, lambda e: F.create_map(F.lit("field"), e["key"], F.lit("value"), e["value"])
        )

    def of_object(largest: Column) -> Column:
        return F.when(largest["n"] > 0, flat(largest["items"])).otherwise(key_values(value))

    return let(
        jsontext.record_items(value),
        lambda items: F.when(F.size(items) > 0, flat(items))
        .when(jsontext.is_object(value), let(jsontext.largest_array(value), of_object))
        .otherwise(F.array().cast(_ROWS)),
    )


def rows(df: DataFrame, doc: str, structured: str) -> DataFrame:
    """``doc_id, row, cells``: one row per exported record of each document."""
    maps = let(jsontext.strict(F.col(structured)), record_maps)
    return unfold(df, [F.col(doc).alias("doc_id")], maps, "row", "cells")


def headers(exported: DataFrame) -> DataFrame:
    """Distinct column names over all records, sorted."""
    keys = unfold(exported, [], F.map_keys("cells"), "_i", "header")
    return keys.select("header").distinct().orderBy("header")


def to_columns(exported: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Records as real columns in sorted order; absent cells are empty.

    Column names must be known on the driver, as in any schema. Without ``names`` the records are written once, the names are read from
    their keys, and the columns are taken from the written records.
    """
    if names is None:
        exported = materialise(exported, "exported")
        names = [r["header"] for r in headers(exported).collect()]
    cell = lambda n: F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))
    return exported.select("doc_id", "row", *[cell(n).alias(n) for n in sorted(names)])


def quote_cell(value: Column, sep: str) -> Column:
    """A cell as a delimited file holds it: quoted only where it has to be."""
    needs = value.rlike(rf'[{sep}"\r\n]') | value.rlike(r"^[ \t]") | (value == r"\.")
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs, quoted).otherwise(value)


def delimited_text(cells: Column, names: Column, sep: str = ",") -> Column:
    """Record maps as one delimited text with a header line, per document."""
    def line(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: quote_cell(v, sep)), sep)

    body = F.transform(
        cells, lambda c: line(F.transform(names, lambda n: F.coalesce(F.try_element_at(c, n), F.lit(""))))
    )
    return F.array_join(F.concat(F.array(line(names)), body), "\n")


def markdown_cell(value: Column) -> Column:
    """A cell that cannot break its row: pipes escaped, line ends opened."""
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit(r"\|")), r"\r?\n", "<br>")


def markdown_text(cells: Column, names: Column) -> Column:
    """Record maps as one Markdown table, per document."""
    def line(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    body = F.transform(
        cells,
        lambda c: line(
            F.transform(names, lambda n: markdown_cell(F.coalesce(F.try_element_at(c, n), F.lit(""))))
        ),
    )
    rule = line(F.transform(names, lambda _: F.lit("---")))
    return F.array_join(
        F.concat(F.array(line(F.transform(names, markdown_cell)), rule), body), "\n"
    )


def header_array(cells: Column) -> Column:
    """Sorted distinct keys of one document's record maps."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(cells, F.map_keys))))


def pretty_json(text: Column) -> Column:
    """Indented JSON with members by name; text that is not JSON passes through unchanged."""
    return F.coalesce(jsontext.pretty(text), text)


def export_name(filename: Column, kind: str) -> Column:
    """Output name for a format, or for the schema export."""
    if kind == "schema":
        return F.concat(file_stem(filename), F.lit("_schema.json"))
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    return F.concat(file_stem(filename), F.lit("_structured" + FORMATS[kind]))


def documents_as(df: DataFrame, doc: str, structured: str, kind: str, empty: str) -> DataFrame:
    """``doc_id, content``: each document's export text in one format."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    if kind == "json":
        return df.select(F.col(doc).alias("doc_id"), pretty_json(F.col(structured)).alias("content"))
    cells = df.select(
        F.col(doc).alias("doc_id"), let(jsontext.strict(F.col(structured)), record_maps).alias("_cells")
    ).withColumn("_names", header_array(F.col("_cells")))
    if kind == "markdown":
        text = markdown_text(F.col("_cells"), F.col("_names"))
    else:
        text = delimited_text(F.col("_cells"), F.col("_names"), "," if kind == "csv" else "\t")
    return cells.select(
        "doc_id",
        F.when(F.coalesce(F.size("_cells"), F.lit(0)) == 0, F.lit(empty)).otherwise(text).alias("content"),
    )
