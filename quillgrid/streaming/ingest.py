"""Documents analysed on arrival: file stream -> the batch expressions -> Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.profile import with_clean_report, with_profile

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Text files as they arrive, one row per file."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", per_batch).load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.xxhash64("path").alias("doc_id"),
        F.col("content").cast("string").alias("raw_content"),
        F.col("modificationTime").alias("created_at"),
    )


def analyse(docs: DataFrame) -> DataFrame:
    """Type, profile and clean report; the same plan for batches and streams."""
    return with_clean_report(with_profile(docs, "raw_content"), "raw_content")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Analyse what has arrived and append it; a restart goes on where the checkpoint ends."""
    return (
        analyse(arriving_files(spark, path)).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
