"""Forms of values, clusters of values that mean the same, and aliases learned from them.

All start from value counts (``field, value, n``; see ``profile.value_counts``), so a frequent value is one row. Groups meet by keys:
a cluster's values share a key, and a misspelling shares a pattern with what is meant. Within a group each value looks at the most frequent
one alone, never at all others, so a group costs its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import normalise
from quillgrid.functions.core import unfold
from quillgrid.functions.text import is_missing

#: Shortest value, in characters, whose misspellings are looked for.
LEAST_LENGTH = 5


def form(value: Column) -> Column:
    """What a value is made of: each run of digits is ``9``, of capitals ``A``, of other letters ``a``, of white space one blank."""
    out = F.regexp_replace(F.btrim(value), r"[0-9]+", "9")
    out = F.regexp_replace(out, r"\p{Lu}+", "A")
    out = F.regexp_replace(out, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")
    return F.regexp_replace(out, r"\s+", " ")


def forms(counts: DataFrame) -> DataFrame:
    """``field, form, n, values``: how often each form occurs in a field, and in how many different values. Missing tokens have no form."""
    shown = counts.where(~is_missing(F.col("value")))
    return shown.groupBy("field", form(F.col("value")).alias("form")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))


def _words(value: Column) -> Column:
    """The words of a value without case and marks."""
    bare = F.regexp_replace(F.lower(F.btrim(value)), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def cluster_key(value: Column) -> Column:
    """The different words of a value, sorted, without case and marks; values of one key differ in writing only."""
    return F.array_join(F.array_sort(F.array_distinct(_words(value))), " ")


def clusters(counts: DataFrame) -> DataFrame:
    """``field, key, value, n, canonical, total``: each value with its cluster's most frequent value and the cluster's count.

    Values without letters are clusters of their own: ``1.50`` is not ``150``. A cluster's values differ in case, marks and the order of words alone; the
    most frequent one is found by an aggregate, and joined to the others.
    """
    key = cluster_key(F.col("value"))
    keyed = counts.where(~is_missing(F.col("value"))).select("field", F.when(key.rlike(r"\p{L}"), key).otherwise(F.col("value")).alias("key"), "value", "n")
    best = keyed.groupBy("field", "key").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("canonical"), F.sum("n").alias("total"))
    return keyed.join(best, ["field", "key"]).select("field", "key", "value", "n", "canonical", "total")


def _first(key: str, total: str) -> Column:
    """Order by falling count, then by key."""
    return F.struct((-F.col(total)).alias("n"), F.col(key).alias("key"))


def misspellings(heads: DataFrame, ratio: int = 3, least: int = LEAST_LENGTH) -> DataFrame:
    """``field, key, near``: clusters whose key is one edit (a letter put in, left out, changed, or swapped with its neighbour) from that of
    a cluster at least ``ratio`` times as frequent; the most frequent such cluster, the smallest of equals.

    ``heads`` has ``field, key, total``, one row a cluster. Keys meet under patterns that tell the edit and its place: a key with one letter
    hidden, with two neighbours in order, or with one letter left out. All keys of such a pattern are one edit apart (of the last kind: from
    the key that is the pattern itself), so each needs the pattern's most frequent key alone. Keys shorter than ``least`` and keys without
    letters are passed over: there one letter is a difference.
    """
    long = heads.where((F.length("key") >= least) & F.col("key").rlike(r"\p{L}")).select("field", "key", "total")
    n = F.length("key")

    def part(at: Column) -> Column:
        return F.substring("key", at, F.lit(1))

    def rest(at: Column) -> Column:
        return F.substring("key", at, n)

    def meeting(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    places = F.sequence(F.lit(1), n)
    hidden = F.transform(places, lambda i: meeting("any", F.concat(F.lit("?"), F.left("key", i - 1), F.lit("\u0001"), rest(i + 1))))
    swapped = F.transform(F.sequence(F.lit(1), n - 1), lambda i: meeting("any", F.concat(
        F.lit("~"), F.left("key", i - 1), F.lit("\u0001"), F.least(part(i), part(i + 1)), F.greatest(part(i), part(i + 1)), F.lit("\u0001"), rest(i + 2))))
    shorter = F.transform(places, lambda i: meeting("longer", F.concat(F.lit("-"), F.left("key", i - 1), rest(i + 1))))
    itself = F.array(meeting("itself", F.concat(F.lit("-"), "key")))
    met = unfold(long, ["field", "key", "total"], F.array_distinct(F.concat(hidden, swapped, shorter, itself)), "_i", "m").select("field", "key", "total", "m.*")
    others = F.col("kind") != "itself"
    best = met.groupBy("field", "pattern").agg(
        F.min_by(F.when(others, F.struct("key", "total")), F.when(others, _first("key", "total"))).alias("most"),
        F.max(F.when(~others, F.struct("key", "total"))).alias("whole"))
    found = met.join(best, ["field", "pattern"]).withColumn("to", F.when(F.col("kind") == "longer", F.col("whole")).otherwise(F.col("most")))
    near = found.where((F.col("to.key") != F.col("key")) & (F.col("to.total") >= F.col("total") * ratio))
    return near.groupBy("field", "key").agg(F.min_by("to.key", F.struct((-F.col("to.total")).alias("n"), F.col("to.key").alias("key"))).alias("near"))


def initials(heads: DataFrame, ratio: int = 3) -> DataFrame:
    """``field, key, near``: keys of two to five letters that are the initials of a cluster's most frequent value, of as many words, which is
    at least ``ratio`` times as frequent as all others of these initials together. ``heads`` has ``field, key, total, canonical``."""
    words = _words(F.col("canonical"))
    short = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    long = heads.where((F.size(words) >= 2) & (F.size(words) <= 5)).select("field", short.alias("_short"), F.col("key").alias("near"), "total")
    best = long.groupBy("field", F.col("_short").alias("key")).agg(
        F.min_by("near", F.struct((-F.col("total")).alias("n"), "near")).alias("near"), F.max("total").alias("_top"), F.sum("total").alias("_all"))
    clear = best.where(F.col("_top") >= (F.col("_all") - F.col("_top")) * ratio).select("field", "key", "near")
    return heads.where(F.col("key").rlike(r"^\p{L}{2,5}$")).select("field", "key").join(clear, ["field", "key"])


def learned_aliases(counts: DataFrame, ratio: int = 3) -> DataFrame:
    """``field, value, alias, n, reason``: values that stand for another one of their field, and that one.

    ``reason`` is ``writing`` (case, marks, order of words), ``spelling`` (one letter off a value ``ratio`` times as frequent) or
    ``initials``. The other value is the most frequent writing of its cluster; aliases are not followed further.
    """
    found = clusters(counts)
    heads = found.groupBy("field", "key").agg(F.max("total").alias("total"), F.max("canonical").alias("canonical"))
    near = misspellings(heads, ratio).withColumn("reason", F.lit("spelling")).unionByName(initials(heads, ratio).withColumn("reason", F.lit("initials")))
    near = near.groupBy("field", "key").agg(F.min_by(F.struct("near", "reason"), F.struct("reason", "near")).alias("to"))
    target = heads.select("field", F.col("key").alias("near"), F.col("canonical").alias("other"))
    to = near.select("field", "key", "to.near", "to.reason").join(target, ["field", "near"]).select("field", "key", "other", "reason")
    joined = found.join(to, ["field", "key"], "left")
    alias = F.coalesce("other", "canonical")
    return joined.where(alias != F.col("value")).select("field", "value", alias.alias("alias"), "n", F.coalesce("reason", F.lit("writing")).alias("reason"))


def with_aliases(df: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """``df`` with the values of some columns replaced by their aliases; others are trimmed. Aliases are a table, joined by its size."""
    out = df
    for c in columns:
        own = aliases.where(F.col("field") == c).select(F.col("value").alias(f"_v_{c}"), F.col("alias").alias(f"_a_{c}"))
        out = out.join(own, F.btrim(F.col(f"`{c}`")) == F.col(f"_v_{c}"), "left")
        out = out.withColumn(c, F.coalesce(f"_a_{c}", F.btrim(F.col(f"`{c}`")))).drop(f"_v_{c}", f"_a_{c}")
    return out


def column_quality(counts: DataFrame) -> DataFrame:
    """``field, total, missing, numbers, dates, number_forms, date_forms``: a table's cells column by column, whatever the columns.

    Numbers and dates are told by the forms that the normalisation knows; each different value is looked at once.
    """
    value = F.col("value")
    absent = is_missing(value)
    rows = counts.select(
        "field", "n", absent.alias("absent"), F.when(~absent & normalise.number(value).isNotNull(), form(value)).alias("number_form"),
        F.when(~absent, normalise.date_form(value)).alias("date_form"))
    return rows.groupBy("field").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("absent"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("number_form").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum(F.when(F.col("date_form").isNotNull(), F.col("n"))), F.lit(0)).alias("dates"),
        F.array_sort(F.collect_set("number_form")).alias("number_forms"), F.array_sort(F.collect_set("date_form")).alias("date_forms"))
