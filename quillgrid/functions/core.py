"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.constants import WHITE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def trim_ws(text: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def occurrences(text: Column, char: str) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def head_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines without splitting the rest of the text."""
    return F.split(F.substring_index(text, "\n", n), "\n", -1)


def percent(part: Column, whole: Column) -> Column:
    """Integer percent, rounded down."""
    return F.floor(part * 100 / whole).cast("int")


def int_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def compact_texts(*items: Column) -> Column:
    """The items that are present, in order, as an array."""
    return F.array_compact(F.array(*items))


def run_counts(items: Column) -> Column:
    """``array<struct<value, n>>``: each distinct item with how often it occurs, sorted.

    Sorting and measuring runs stays near linear for rows with very many items.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.struct(x.alias("value"), i.alias("i"))),
            lambda e: (e["i"] == 0) | (F.get(s, e["i"] - 1) != e["value"]),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda e, j: F.struct(
                    e["value"].alias("value"),
                    (F.coalesce(F.get(st, j + 1)["i"], F.size(s)) - e["i"]).alias("n"),
                ),
            ),
        )

    return let(F.array_sort(items), runs)


def running_sums(items: Column) -> Column:
    """``array<int>``: the sum up to and with each item.

    Appending copies what is there already, so sums are built in blocks of about the root of the size and each block starts from the
    sum of those before it.
    """
    none = F.array().cast("array<int>")
    start = lambda: F.struct(F.lit(0).alias("now"), none.alias("sums"))

    def add(acc: Column, x: Column) -> Column:
        now = acc["now"] + x
        return F.struct(now.alias("now"), F.concat(acc["sums"], F.array(now)).alias("sums"))

    def in_blocks(a: Column, width: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(a), width), lambda i: i <= F.size(a))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(a, i, width), start(), add))

        def joined(bs: Column) -> Column:
            before = F.aggregate(F.transform(bs, lambda b: b["now"]), start(), add, lambda acc: acc["sums"])
            return let(before, lambda t: F.flatten(
                F.transform(bs, lambda b, j: F.transform(b["sums"], lambda x: x + F.coalesce(F.get(t, j - 1), F.lit(0))))))

        return let(blocks, joined)

    def sums(a: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda width: in_blocks(a, width))

    return let(items, lambda a: F.when(F.size(a) == 0, none).otherwise(sums(a)))


def unfold_present(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """The kept columns and ``value``, for rows where it is present.

    A plain filter on a computed column is pushed below its computation, which then runs twice.
    """
    rows = unfold(df, keep, F.array_compact(F.array(value)), "_i", name)
    return rows.drop("_i")


def unfold(df: DataFrame, keep: list, items: Column, *names: str) -> DataFrame:
    """One row per item of an array or map: the kept columns, then position and item under ``names``.

    The outer form is used on purpose. For the inner form the optimizer adds a filter on the array's
    size and pushes it to the scan with every step that computes the array written out again, so
    the work would be done twice or more. Rows without items drop out by their missing position.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(*names)).where(F.col(names[0]).isNotNull())
