"""References between the columns of several tables: inclusion dependencies found in one pass.

A column refers to another if each of its values occurs there. All values of all columns meet once: a value is mapped to the set of columns
that hold it, equal sets are counted, and the counts of sets that hold two columns tell how many values they share. So the work is one
grouping of distinct values, whatever the number of pairs; sets are as large as the number of columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMA = ("child_table string, child string, parent_table string, parent string, child_values bigint, shared_values bigint, orphans bigint, "
           "parent_unique boolean, is_reference boolean")


def comparable(kind: T.DataType) -> str | None:
    """The class of types within which columns may refer to one another; None for nested types."""
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None


def _as_text(column: Column, kind: str) -> Column:
    """Equal texts for equal values of a class, whatever the type's width."""
    if kind == "integer":
        return column.cast("decimal(38,0)").cast("string")
    if kind == "number":
        return column.cast("double").cast("string")
    if kind == "time":
        return column.cast("timestamp_ntz").cast("string")
    return column


def _ordered(column: Column, kind: str) -> Column:
    """A value by whose order ranges are compared, as text."""
    return column.cast("decimal(38,0)") if kind == "integer" else column.cast("double") if kind == "number" else column.cast("timestamp_ntz") if kind == "time" else column


def _ranges(tables: Mapping[str, DataFrame]) -> list[tuple[int, str, str, str, object, object]]:
    """``(number, table, column, class, low, high)`` of the columns that hold values: one row a table goes to the driver."""
    out = []
    for name, df in tables.items():
        kinds = {f.name: comparable(f.dataType) for f in df.schema.fields}
        used = {c: k for c, k in kinds.items() if k}
        if not used:
            continue
        row = df.agg(*[f(_ordered(F.col(f"`{c}`"), k)).alias(f"{n}{i}") for i, (c, k) in enumerate(used.items()) for n, f in (("low", F.min), ("high", F.max))]).first()
        for i, (c, k) in enumerate(used.items()):
            if row[f"low{i}"] is not None:
                out.append((len(out), name, c, k, row[f"low{i}"], row[f"high{i}"]))
    return out


def _may_refer(child: tuple, parent: tuple) -> bool:
    return child[0] != parent[0] and child[3] == parent[3] and parent[4] <= child[4] and child[5] <= parent[5]


def reference_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of columns whose type classes agree and whose ranges allow that one refers to the other.

    ``child_values`` counts the child's distinct values, ``shared_values`` those that the parent holds, ``orphans`` the rest.
    ``is_reference`` tells that there are no orphans and the parent's values are unique. Null values refer to nothing; columns without
    values and nested columns are left out. Types and ranges are looked at first, and columns without a possible partner are not read again.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = _ranges(tables)
    pairs = [(a, b) for a in columns for b in columns if _may_refer(a, b)]
    if not pairs:
        return spark.createDataFrame([], _SCHEMA)
    wanted = {c[0] for pair in pairs for c in pair}
    cells = None
    for name, df in tables.items():
        own = [c for c in columns if c[1] == name and c[0] in wanted]
        if not own:
            continue
        values = F.array(*[F.struct(F.lit(c[0]).alias("column"), F.lit(c[3]).alias("kind"), _as_text(F.col(f"`{c[2]}`"), c[3]).alias("value")) for c in own])
        part = df.select(F.explode(values).alias("cell")).select("cell.*").where("value IS NOT NULL")
        cells = part if cells is None else cells.unionByName(part)
    # Repeats collapse before the shuffle, and the key holds the value, so neither a frequent value nor a long column falls to one task.
    counted = cells.groupBy("kind", "value", "column").agg((F.count(F.lit(1)) > 1).alias("again"))
    held = counted.groupBy("kind", "value").agg(F.array_sort(F.collect_list(F.struct("column", "again"))).alias("held"))
    sets = held.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    both = sets.select(F.explode("held").alias("child"), "held", "n").select(F.col("child.column").alias("child"), F.explode("held").alias("parent"), "n")
    named = spark.createDataFrame([(a[0], b[0], a[1], a[2], b[1], b[2]) for a, b in pairs],
                                  "child int, parent int, child_table string, child_name string, parent_table string, parent_name string")
    # Pairs that share no value take part with 0. From here on there are at most as many rows as pairs of columns.
    nothing = named.select("child", F.struct(F.col("parent").alias("column"), F.lit(False).alias("again")).alias("parent"), F.lit(0).cast("long").alias("n"))
    overlap = both.unionByName(nothing).groupBy("child", F.col("parent.column").alias("parent")).agg(F.sum("n").alias("shared"), F.max("parent.again").alias("again"))
    own = F.col("child") == F.col("parent")
    sized = overlap.select(
        "child", "parent", "shared", F.max(F.when(own, F.col("shared"))).over(Window.partitionBy("child")).alias("child_values"),
        F.max(F.when(own, ~F.col("again"))).over(Window.partitionBy("parent")).alias("parent_unique"))
    found = named.join(sized, ["child", "parent"])
    return found.select(
        "child_table", F.col("child_name").alias("child"), "parent_table", F.col("parent_name").alias("parent"), "child_values",
        F.col("shared").alias("shared_values"), (F.col("child_values") - F.col("shared")).alias("orphans"), "parent_unique",
        ((F.col("shared") == F.col("child_values")) & F.col("parent_unique")).alias("is_reference"))
