"""Relational state: documents, sessions, collections, memberships, messages, milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions.core import unfold


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with a key; the equality reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(value))


def newest(df: DataFrame, columns: list[str], *order: Column, n: int | None = None) -> DataFrame:
    """The rows newest first, light columns only; the first ``n`` if a number is given."""
    rows = df.select(*columns).orderBy(*order)
    return rows if n is None else rows.limit(n)


def preview(text: Column, n: int, marker: str = K.CUT_MARKER) -> Column:
    """The first ``n`` characters (code points) with a marker where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


def raw_preview(text: Column, n: int) -> Column:
    """As ``preview``, counting code points; the marker tells how many there are."""
    marker = F.concat(
        F.lit("\n\n... [truncated, "), F.length(text).cast("string"), F.lit(" chars total]")
    )
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), marker)).otherwise(text)


def digest(df: DataFrame, doc: str, name: str, raw: str, structured: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents as text blocks, whole: structured data if present, else raw text. ``keep`` names columns to pass on."""
    head = F.concat(
        F.lit("=== Document #"), F.col(doc).cast("string"), F.lit(": "), F.col(name), F.lit(" ===\n")
    )
    has = F.coalesce(F.col(structured), F.lit("")) != ""
    body = F.when(
        has, F.concat(F.lit("Structured data:\n"), F.col(structured), F.lit("\n\n"))
    ).when(
        F.coalesce(F.col(raw), F.lit("")) != "",
        F.concat(F.lit("Raw content:\n"), F.col(raw), F.lit("\n\n")),
    ).otherwise("")
    return df.select(*keep, F.col(doc).alias("doc_id"), F.concat(head, body).alias("block"))


def listing_line(doc: Column, name: Column, created: Column) -> Column:
    return F.concat(
        F.lit("#"), doc.cast("string"), F.lit(": "), name, F.lit(" ("),
        F.date_format(created, "yyyy-MM-dd HH:mm"), F.lit(")"),
    )


def presence(structured: Column, schema: Column, summary: Column) -> Column:
    """What is missing for a document, in the order the steps are done."""
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(absent(structured), "not parsed")
        .when(absent(schema), "no schema")
        .when(absent(summary), "no summary")
        .otherwise("complete")
    )


def collection_counts(collections: DataFrame, memberships: DataFrame, key: str, member: str) -> DataFrame:
    """Members per collection; empty collections count 0.

    Memberships are counted before the join, so a collection holding most members arrives as one row.
    """
    counts = memberships.groupBy(key).agg(F.count(member).alias("doc_count"))
    return collections.join(counts, key, "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Existing rows plus the first new row of every key that is not there yet."""
    columns = existing.columns
    rest = F.struct(order.alias("_order"), *[F.col(c) for c in columns])
    first = (
        new.select(*keys, rest.alias("_row")).groupBy(*keys).agg(F.min("_row").alias("_row"))
        .select("_row.*").select(*columns)
    )
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def upsert(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the given columns replaced where an update has a value."""
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(fresh, key, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def clear(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the doomed."""
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def latest_per(df: DataFrame, owner: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each owner. An aggregate with map-side combining, not a sorted window."""
    ranked = F.struct(*order)
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(owner).agg(F.max_by(row, ranked).alias("_row")).select(owner, "_row.*")


def recent(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group, numbered oldest first from 1."""
    newest_first = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    oldest_first = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= n)
        .withColumn("place", F.row_number().over(oldest_first))
        .drop("_back")
    )


def milestones(
    events: DataFrame, session: str, action: str, ts: str, actions: dict[str, str] | None = None,
    power_action: str = "upload", power_at: int = K.POWER_USER_DOCUMENTS,
) -> DataFrame:
    """``session, milestone, earned_at``: the first event of each kind, once per session.

    The fifth processed document also earns a milestone; its time is the fifth event's.
    """
    named = actions or K.MILESTONES
    mapping = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    keyed = events.select(
        F.col(session).alias("session"), F.col(action).alias("action"), F.col(ts).alias("ts"),
    ).where(F.col("action").isin(*named))
    first = (
        keyed.groupBy("session", "action").agg(F.min("ts").alias("earned_at"))
        .select("session", F.try_element_at(mapping, F.col("action")).alias("milestone"), "earned_at")
    )
    order = Window.partitionBy("session").orderBy("ts")
    fifth = (
        keyed.where(F.col("action") == power_action)
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= power_at)
        .where(F.col("n") == power_at)
        .select("session", F.lit(K.POWER_USER).alias("milestone"), F.col("ts").alias("earned_at"))
    )
    return first.unionByName(fifth)


def compare_fields(docs: DataFrame, names: str) -> DataFrame:
    """For each field: in how many documents it occurs, and whether all documents with fields share it.

    ``names`` is each document's array of distinct field names. A field is counted, never gathered:
    only one counter per field and task crosses the shuffle.
    """
    total = docs.agg(F.count_if(F.size(names) > 0).alias("n")).scalar()
    return (
        unfold(docs, [], F.col(names), "_i", "field")
        .groupBy("field").agg(F.count(F.lit(1)).alias("documents"))
        .withColumn("total_documents", total)
        .withColumn("shared", F.col("documents") == F.col("total_documents"))
    )


def compare_in_collections(docs: DataFrame, collection: str, names: str) -> DataFrame:
    """For each collection and field: ``documents, total_documents, shared``. ``total_documents`` counts the collection's documents with fields.

    ``names`` is each document's array of field names. Only counters cross the shuffle, so a collection that holds most documents is a few rows.
    """
    own = docs.select(F.col(collection).alias("collection"), F.array_distinct(names).alias("_names")).where(F.size("_names") > 0)
    totals = own.groupBy("collection").agg(F.count(F.lit(1)).alias("total_documents"))
    fields = unfold(own, ["collection"], F.col("_names"), "_i", "field").groupBy("collection", "field").agg(F.count(F.lit(1)).alias("documents"))
    return fields.join(totals, "collection").withColumn("shared", F.col("documents") == F.col("total_documents"))


def document_field_totals(docs: DataFrame, doc: str, collection: str, names: str, compared: DataFrame) -> DataFrame:
    """``doc_id, collection, n_fields, shared_fields, different_fields`` of every document.

    ``compared`` is what ``compare_in_collections`` tells of the same documents. A document without fields shares none.
    """
    shared = compared.groupBy("collection").agg(F.count_if("shared").alias("_shared"))
    n = F.size(F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))).cast("bigint")
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(collection).alias("collection"), n.alias("n_fields"))
    have = F.when(F.col("n_fields") > 0, F.coalesce("_shared", F.lit(0))).otherwise(0).cast("bigint")
    return rows.join(shared, "collection", "left").select(
        "doc_id", "collection", "n_fields", have.alias("shared_fields"), (F.col("n_fields") - have).alias("different_fields"))


def in_order(earned: DataFrame) -> DataFrame:
    """Milestones with their ``place`` in the order a session earned them; of those earned at once the first by name."""
    return earned.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("earned_at", "milestone")))


def field_difference(left: Column, right: Column) -> Column:
    """``struct<only_left, only_right, both>`` of two documents' field names."""
    return F.struct(
        F.array_sort(F.array_except(left, right)).alias("only_left"),
        F.array_sort(F.array_except(right, left)).alias("only_right"),
        F.array_sort(F.array_intersect(left, right)).alias("both"),
    )
