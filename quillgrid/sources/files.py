"""Reading documents from files and from text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import csvtext, jsontext
from quillgrid.functions.core import unfold

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents_from_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per text file: ``path, filename, raw_content, created_at``.

    A file is read whole; only if a ``limit`` is given, bytes beyond it are cut.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        (F.col("content") if limit is None else F.col("content").substr(1, limit)).cast("string").alias("raw_content"),
        F.col("modificationTime").alias("created_at"),
    )


def csv_file(
    spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """A delimited file with a header; the schema is given or all columns stay text.

    Quoted line ends need ``multi_line``. Where fields hold none, turning it off lets Spark split
    large files.
    """
    reader = (
        spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
        .option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("sep", sep)
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def json_file(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Files of JSON records, one per line; with ``multi_line`` one value or array per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def csv_rows(df: DataFrame, doc: str, text: str, strict: bool = False) -> DataFrame:
    """Records of delimited text in a column: ``doc_id, row, fields, n_fields, ragged``.

    ``strict`` keeps no rows of a document whose records differ in field count.
    """
    parsed = df.select(
        F.col(doc).alias("doc_id"), csvtext.records(F.col(text), repair=not strict).alias("_r")
    ).withColumn("_w", F.size(F.get("_r", F.lit(0))))
    if strict:
        parsed = parsed.where(F.forall("_r", lambda r: F.size(r) == F.col("_w")))
    return unfold(parsed, ["doc_id", "_w"], F.col("_r"), "row", "fields").select(
        "doc_id", "row", "fields", F.size("fields").alias("n_fields"),
        (F.size("fields") != F.col("_w")).alias("ragged"),
    )


def json_shape(text: Column) -> Column:
    """``struct<shape, rows>``: records, object or error, and how many records the text holds."""
    value = jsontext.strict(text)
    parts = F.struct(
        jsontext.record_array(value).alias("rows"), jsontext.as_object(value).alias("members"),
    )
    shaped = F.transform(
        F.array(parts),
        lambda s: F.when(F.size(s["rows"]) > 0, F.struct(F.lit("records").alias("shape"), F.size(s["rows"]).alias("rows")))
        .when(s["members"].isNotNull(), F.struct(F.lit("object").alias("shape"), F.lit(1).alias("rows")))
        .otherwise(F.struct(F.lit("error").alias("shape"), F.lit(0).alias("rows"))),
    )
    return shaped.getItem(0)
