"""Small DataFrame helpers of the package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import materialise
from quillgrid.sources.files import table

__all__ = ["give_back", "held_out", "hinted", "lean", "materialise", "parts_of", "range_bucket", "small_batches", "table"]


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most 2,000 rows: texts are long, and two tasks share an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 2000:
        spark.conf.set(name, "2000")
    return spark


def parts_of(spark: SparkSession, factor: int = 1) -> int:
    """How many buckets to deal rows into: the session's shuffle partitions, times a factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def range_bucket(df: DataFrame, column: str, n: int) -> Column:
    """Buckets 0 to n - 1 of about equal row counts in the order of a number; null falls in the first.

    The bounds are approximate quantiles (at most n numbers), so any distribution of ids is dealt evenly.
    """
    if n <= 1:
        return F.lit(0)
    cuts = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], max(0.1 / n, 1e-4))
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts)
    return F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(column).cast("double"))), F.lit(0))


#: Rows of a stored table of ids that every task may hold (some 20 MB).
MOST_BROADCAST = 1_000_000


def hinted(stored: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it is counted to be small; else the planner decides."""
    return F.broadcast(stored) if stored.count() <= MOST_BROADCAST else stored


def give_back() -> None:
    """Return what this worker has freed to the system: workers are used again by later stages, which share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this system's C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of ``mapInArrow`` that gives memory back before and after its task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task
