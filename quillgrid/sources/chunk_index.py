"""The stored chunk index: chunks, postings, term and corpus statistics as Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.core import unfold
from quillgrid.operators import search
from quillgrid.operators.search import CHUNK_KEY
from quillgrid.session import materialise

# Stated, because a collection named like a number would otherwise be read back as one.
CHUNK_SCHEMA = (
    "collection_id string, doc_id bigint, position int, content string, tokens array<string>, dl int, "
    "bucket int"
)
# Chunks are partitioned by a hash bucket of their collection: the number of directories stays the
# same however many collections there are.
BUCKETS = 64
# Bytes of a row group of chunks: readers split files between row groups, and a search in one collection skips them.
ROW_GROUP = 16 * 2**20
CHUNK_COLUMNS = (*CHUNK_KEY, "content", "tokens", "dl")


class Index(Protocol):
    """What ranking reads of an index."""

    def postings(self, spark: SparkSession) -> DataFrame: ...

    def terms(self, spark: SparkSession) -> DataFrame: ...

    def stats(self, spark: SparkSession) -> DataFrame: ...

    def bucketed_chunks(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class ChunkIndex:
    """Paths of one index version. Readers switch versions by path."""

    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        return read_chunks(spark, f"{self.path}/chunks")

    def bucketed_chunks(self, spark: SparkSession) -> DataFrame:
        """Chunks with their ``bucket``, the column by which directories are pruned."""
        return spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.path}/chunks")

    def postings(self, spark: SparkSession) -> DataFrame:
        """``term, collection_id, doc_id, position, tf, dl``, clustered by term."""
        return spark.read.parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        """``collection_id, term, df``, clustered by term."""
        return spark.read.parquet(f"{self.path}/terms")

    def stats(self, spark: SparkSession) -> DataFrame:
        """``collection_id, n_chunks, avg_dl, total_dl``."""
        return spark.read.parquet(f"{self.path}/stats")

    def collection(self, spark: SparkSession, collection_id: str) -> DataFrame:
        """Chunks of one collection in (document, position) order.

        Only the collection's bucket is read, and in it only row groups that can hold the collection.
        """
        return (
            read_chunks(spark, f"{self.path}/chunks", collection_id).where(F.col("collection_id") == collection_id)
            .orderBy("doc_id", "position")
        )


def bucket_of(collection: Column) -> Column:
    return F.pmod(F.xxhash64(collection), F.lit(BUCKETS)).cast("int")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Store chunks with tokens, clustered by collection inside its bucket.

    The rebalance hint lets Spark size the output by bytes: small buckets share a task, and a bucket
    with a collection holding most rows is split over many. Only the text is shuffled and sorted; its tokens,
    which take more room, are taken from it on the way to the file.
    """
    bucketed = chunks.select(*CHUNK_KEY, "content", bucket_of(F.col("collection_id")).alias("bucket"))
    placed = bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *CHUNK_KEY)
    search.with_tokens(placed).select(*CHUNK_COLUMNS, "bucket").write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str, collection_id: str | None = None) -> DataFrame:
    """Stored chunks; with a collection, only those of its bucket."""
    stored = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    if collection_id is not None:
        stored = stored.where(F.col("bucket") == bucket_of(F.lit(collection_id)))
    return stored.select(*CHUNK_COLUMNS)


def write_index(chunks: DataFrame, path: str, keys: DataFrame | None = None) -> ChunkIndex:
    """Store chunks and what ranking needs, and the ``keys`` (``collection_id, doc_id``) of the documents, by default those with chunks.

    Postings and terms are range-partitioned by
    term first, so that a query's terms are a few row groups of a few files. The range key goes on
    to the document, so a term found in most chunks is spread over many files.
    """
    write_chunks(chunks, f"{path}/chunks")
    return add_postings(chunks.sparkSession, ChunkIndex(path), keys)


def add_postings(spark: SparkSession, index: ChunkIndex, keys: DataFrame | None = None) -> ChunkIndex:
    """What ranking needs, from the chunks stored under the index's path; before this, only its chunks can be read."""
    path, stored = index.path, index.chunks(spark)
    keys = stored.select("collection_id", "doc_id").distinct() if keys is None else keys
    keys.select(F.col("collection_id").cast("string"), F.col("doc_id").cast("bigint"), F.lit(True).alias("live")).write.parquet(f"{path}/keys")
    search.corpus_stats(stored).write.parquet(f"{path}/stats")
    by_term = ("term", "collection_id", "doc_id")
    postings = search.term_counts(stored).select(*by_term, "position", "tf", "dl")
    postings.repartitionByRange(*by_term).sortWithinPartitions(*by_term).write.parquet(f"{path}/postings")
    counts = search.document_frequency(index.postings(spark))
    counts.repartitionByRange("term", "collection_id").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return index


def document_keys(docs: DataFrame, doc: str, collection: str) -> DataFrame:
    return docs.select(F.col(collection).alias("collection_id"), F.col(doc).alias("doc_id"))


def build_index(docs: DataFrame, doc: str, collection: str, text: str, path: str) -> ChunkIndex:
    return write_index(search.chunk(docs, doc, collection, text), path, document_keys(docs, doc, collection))


def build_chunks(docs: DataFrame, doc: str, collection: str, text: str, path: str) -> ChunkIndex:
    """The chunks of an index alone; ``add_postings`` with the same documents' keys makes it whole."""
    write_chunks(search.chunk(docs, doc, collection, text), f"{path}/chunks")
    return ChunkIndex(path)


def ranked(
    spark: SparkSession, index: Index, queries: Iterable[tuple[str, str]], k: int, collections: Iterable[str] | None = None
) -> DataFrame:
    """The ``k`` best chunks per (query, collection) from the stored postings, without their text; ``k <= 0`` keeps all.

    Only postings of the asked terms, and of the named ``collections`` if any are, are read: both filters reach the
    Parquet scan, where the clustering lets them skip row groups. What is shuffled is one narrow row per matching chunk.
    """
    asked = search.query_terms(queries)
    terms = sorted({t for q in asked.values() for t in q})
    if not terms:
        return spark.createDataFrame([], search.RANKED_SCHEMA)
    wanted = F.col("term").isin(terms)
    among = F.lit(True) if collections is None else F.col("collection_id").isin(sorted(set(collections)))
    # Which queries ask for a term, and how often: a literal as large as the query texts.
    asks = F.create_map(
        *[
            x
            for t in terms
            for x in (
                F.lit(t),
                F.array(
                    *[
                        F.struct(F.lit(n).alias("query_id"), F.lit(q[t]).alias("qtf"))
                        for n, q in asked.items() if t in q
                    ]
                ),
            )
        ]
    )
    # One row per asked term and collection, written so that its size decides how it is joined. A
    # term that holds most postings then needs no shuffle of them.
    known = materialise(index.terms(spark).where(wanted & among).join(index.stats(spark).where(among), "collection_id"), "terms")
    hits = index.postings(spark).where(wanted & among).join(known, ["collection_id", "term"])
    gain = F.col("a.qtf") * search.term_gain(
        F.col("tf"), F.col("df"), F.col("dl"), F.col("n_chunks"), F.col("avg_dl")
    )
    scored = (
        unfold(
            hits, [*search.CHUNK_KEY, "tf", "df", "dl", "n_chunks", "avg_dl"],
            F.try_element_at(asks, F.col("term")), "_i", "a",
        )
        .groupBy(F.col("a.query_id").alias("query_id"), *search.CHUNK_KEY)
        .agg(F.sum(gain).alias("score"))
        .where(F.col("score") > 0)
    )
    return search.top_chunks(scored, k)


def search_index(
    spark: SparkSession, index: Index, queries: Iterable[tuple[str, str]], k: int, collections: Iterable[str] | None = None
) -> DataFrame:
    """``ranked`` with the text of each chunk.

    The ranking is written first, each hit with the bucket of its collection. Its true size is then known to the planner,
    which broadcasts it to the chunk scan while it is small, and takes the buckets for dynamic partition pruning: only
    directories of collections that are hit are read, and the text column is never shuffled.
    """
    best = materialise(ranked(spark, index, queries, k, collections).withColumn("bucket", bucket_of(F.col("collection_id"))), "ranked")
    texts = index.bucketed_chunks(spark).select(*search.CHUNK_KEY, "bucket", "content")
    if collections is not None:
        texts = texts.where(F.col("collection_id").isin(sorted(set(collections))))
    # The planner prunes by a join only if the other side is filtered.
    return texts.join(best.where("rank > 0"), [*search.CHUNK_KEY, "bucket"]).select(
        "query_id", "collection_id", "rank", "doc_id", "position", "score", "content"
    )


def replace_documents(old: DataFrame, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Chunks after replacing every (collection, document) of ``changed``, or of ``new`` itself."""
    key = ["collection_id", "doc_id"]
    doomed = (changed if changed is not None else new).select(*key).distinct()
    return old.join(doomed, key, "left_anti").unionByName(new)


def remove_collection(chunks: DataFrame, collection_id: str) -> DataFrame:
    return chunks.where(F.col("collection_id") != collection_id)
