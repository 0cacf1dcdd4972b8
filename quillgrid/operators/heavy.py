"""The most frequent values of every column, exact, without shuffling all distinct values.

A frequent-items sketch per column names candidates; it need not be right. One counting pass then counts the candidates exactly and all
other values by hash bucket. A bucket holds at least as many rows as each value in it, so a value outside the candidates can be among the
``k`` most frequent only if its bucket has no fewer rows than the candidate on place ``k``. Just those buckets are counted value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import materialise

TRACKED = 1000
BUCKETS = 1 << 16


def value_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value``: the trimmed texts of the named columns, absent and empty ones left out."""
    texts = df.select(*[F.btrim(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    return texts.unpivot([], [F.col(f"`{c}`") for c in columns], "field", "value").where("value <> ''")


def candidates(cells: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``field, value``: at most ``tracked`` values of each field, the frequent ones very likely among them."""
    sketch = cells.groupBy("field").agg(F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("top"))
    return sketch.select("field", F.explode("top").alias("t")).select("field", F.col("t.item").alias("value"))


def count_in_buckets(cells: DataFrame, named: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``field, value, bucket, n``: rows of each named value (no bucket), and of all other values by hash bucket (no value)."""
    known = named.withColumn("_known", F.lit(True))
    met = cells.join(known, ["field", "value"], "left")
    other = F.col("_known").isNull()
    return met.groupBy(
        "field", F.when(~other, F.col("value")).alias("value"), F.when(other, _bucket(buckets)).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("value"), F.lit(buckets))


def _first(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def open_buckets(counted: DataFrame, k: int) -> DataFrame:
    """``field, bucket``: buckets that may hide one of the ``k`` most frequent values; equal counts stay open, as ties go by value."""
    last = _first(counted.where("bucket IS NULL"), k).where(F.col("rank") == k).select("field", F.col("n").alias("least"))
    rest = counted.where("bucket IS NOT NULL").join(last, "field", "left")
    return rest.where(F.col("n") >= F.coalesce("least", F.lit(0))).select("field", "bucket")


def top_values(df: DataFrame, columns: list[str], k: int, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """``field, rank, value, n``: the ``k`` most frequent values of each named column, equal counts by value.

    Columns with few or clearly frequent values shuffle sketches and bucket counts alone. A column whose values are all about equally
    frequent keeps its buckets open, so its values are counted one by one. Empty and absent values don't count; a column without others
    gives no rows.
    """
    cells = value_cells(df, columns)
    named = materialise(candidates(cells, tracked), "candidates")
    counted = materialise(count_in_buckets(cells, named, buckets), "bucket_counts")
    rest = cells.join(named, ["field", "value"], "left_anti").withColumn("bucket", _bucket(buckets))
    exact = rest.join(open_buckets(counted, k), ["field", "bucket"], "left_semi").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.where("bucket IS NULL").select("field", "value", "n").unionByName(exact)
    return _first(counts, k).select("field", "rank", "value", "n")
