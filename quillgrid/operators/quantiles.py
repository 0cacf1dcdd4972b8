"""Exact quantiles of columns of any length, in three counting passes.

A number is mapped to a 64-bit key in its own order, and ranks are found digit by digit: each pass counts the next digit's values among the
numbers that share the digits found so far. A pass shuffles at most one count for each digit value and task; which digits are followed is a
table of a few rows. Nothing is gathered, and all is one plan, run when its result is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the three digits, from the highest.
DIGITS = (22, 21, 21)
_HALF = 1 << 52


def order_key(value: Column) -> Column:
    """A 64-bit number in the order of a double; ``-0.0`` is 0, infinities and NaN (the greatest) lie at the ends.

    The exponent and the 52 bits of the fraction, taken apart by exact divisions by powers of two.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    fixed = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0) - F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    exponent = F.greatest(fixed, F.lit(-1022))
    fraction = (size / F.pow(F.lit(2.0), exponent)) * float(_HALF)
    finite = (exponent + 1022).cast("long") * _HALF + fraction.cast("long")
    key = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit((1 << 63) - 2)).otherwise(finite)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -key).otherwise(key)


def _digit(key: Column, at: int) -> Column:
    low = sum(DIGITS[at + 1:])
    digit = F.shiftright(key, low)
    return digit if at == 0 else digit.bitwiseAND(F.lit((1 << DIGITS[at]) - 1))


def quantiles(df: DataFrame, columns: list[str], ps: tuple[float, ...]) -> DataFrame:
    """``field, p, value``: quantiles between order statistics, interpolated. Nulls don't count; a column without numbers has no rows."""
    numbers = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x"))
    numbers = numbers.select("x.field", "x.v").where("v IS NOT NULL").withColumn("key", order_key(F.col("v")))
    numbers = numbers.select("field", "v", *[_digit(F.col("key"), i).alias(f"d{i}") for i in range(len(DIGITS))])
    found = None
    for i in range(len(DIGITS)):
        have = ["field", *[f"d{j}" for j in range(i)]]
        last = i == len(DIGITS) - 1
        rows = numbers if found is None else numbers.join(F.broadcast(found.select(*have).distinct()), have)
        counts = rows.groupBy(*have, f"d{i}").agg(F.count(F.lit(1)).alias("n"), *([F.min("v").alias("v")] if last else []))
        # At most one row for each value of a digit.
        order = Window.partitionBy(*have).orderBy(f"d{i}")
        counts = counts.withColumn("before", F.sum("n").over(order) - F.col("n"))
        if found is None:
            total = counts.groupBy("field").agg(F.sum("n").alias("total"))
            places = F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for p in ps])
            asked = total.select("field", F.explode(places).alias("w")).select("field", "w.p", "w.at")
            ranks = F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank")))
            found = asked.select("field", "p", "at", F.explode(ranks).alias("r")).select("field", "p", "at", "r.side", "r.rank")
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        # Two ranks for each column and wanted share: a few rows.
        found = counts.join(F.broadcast(found), have).where(inside).withColumn("rank", F.col("rank") - F.col("before")).drop("n", "before")
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    ends = found.groupBy("field", "p", "at").agg(low.alias("low"), high.alias("high"))
    share = F.col("at") - F.floor("at")
    return ends.select("field", "p", F.when(share == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share).alias("value"))


def fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """``field, q1, q3, low, high``: quartiles and the interquartile fences, one row a column."""
    q1, q3 = (F.max(F.when(F.col("p") == p, F.col("value"))) for p in (0.25, 0.75))
    both = quantiles(df, columns, (0.25, 0.75)).groupBy("field").agg(q1.alias("q1"), q3.alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * factor
    return both.select("field", "q1", "q3", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
