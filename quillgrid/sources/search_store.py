"""A searchable index that changes: immutable segments under a manifest of versions.

A segment holds what one batch wrote: the documents it set or removed (``keys``), their chunks, postings, and signed counts, by which terms
and corpus statistics change. A cleared collection is one row of a segment of its own. Readers merge the segments of one version: a row
counts unless a later segment set its document or cleared its collection, and counts are summed. So a batch costs what it changes, and a
clear costs one row. Compaction folds all segments into one.

A version is one row in one file of the manifest, written last, so chunks, postings, statistics and memberships change together: a reader
sees all of a version or nothing of it. Versions are numbered; a second writer of the same number fails. Segments are never changed, so a
reader keeps its version while others are written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import search
from quillgrid.sources import chunk_index
from quillgrid.sources.chunk_index import CHUNK_COLUMNS, ChunkIndex, bucket_of, write_chunks

KEY = ("collection_id", "doc_id")
_SCHEMAS = {
    "keys": "collection_id string, doc_id bigint, live boolean",
    "chunks": chunk_index.CHUNK_SCHEMA,
    "postings": "term string, collection_id string, doc_id bigint, position int, tf int, dl int",
    "terms": "collection_id string, term string, df bigint",
    "stats": "collection_id string, n_chunks bigint, total_dl bigint",
    "cleared": "collection_id string",
}
_MANIFEST = "segments array<struct<seq: bigint, path: string, kind: string>>, batch bigint, version bigint"


@dataclass(frozen=True)
class Segment:
    seq: int
    path: str
    #: ``base``: a whole index, ``batch``: set and removed documents, ``clear``: a cleared collection.
    kind: str


@dataclass(frozen=True)
class Snapshot:
    """One version of the index. Its tables hold what counts in that version."""

    spark: SparkSession
    version: int
    segments: tuple[Segment, ...]
    #: The last streaming batch that went in, -1 if none did.
    batch: int

    def _read(self, name: str, segments: Iterable[Segment]) -> DataFrame:
        """Rows of several segments with their ``seq``, one scan for each."""
        parts = [
            self.spark.read.schema(_SCHEMAS[name]).parquet(f"{s.path}/{name}").withColumn("seq", F.lit(s.seq)) for s in segments
        ]
        if not parts:
            return self.spark.createDataFrame([], _SCHEMAS[name] + ", seq bigint")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _holding(self) -> list[Segment]:
        return [s for s in self.segments if s.kind != "clear"]

    def _uncleared(self, rows: DataFrame) -> DataFrame:
        """Rows whose collection no later segment cleared."""
        clears = [s for s in self.segments if s.kind == "clear"]
        if not clears:
            return rows
        gone = self._read("cleared", clears).groupBy("collection_id").agg(F.max("seq").alias("_cleared"))
        return rows.join(gone, (rows["collection_id"] == gone["collection_id"]) & (F.col("seq") < F.col("_cleared")), "left_anti")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that no later segment set, removed or cleared.

        Only keys written after the first segment are read. The join compares by key, so its size decides how Spark runs it.
        """
        later = [s for s in self._holding()[1:]]
        if later:
            last = self._read("keys", later).groupBy(*KEY).agg(F.max("seq").alias("_last"))
            same = [rows[c] == last[c] for c in KEY]
            rows = rows.join(last, [*same, F.col("seq") < F.col("_last")], "left_anti")
        return self._uncleared(rows)

    def chunks(self, spark: SparkSession | None = None) -> DataFrame:
        return self.bucketed_chunks().select(*CHUNK_COLUMNS)

    def bucketed_chunks(self, spark: SparkSession | None = None) -> DataFrame:
        """Chunks with their ``bucket``, the column by which directories are pruned."""
        return self._current(self._read("chunks", self._holding())).select(*CHUNK_COLUMNS, "bucket")

    def postings(self, spark: SparkSession | None = None) -> DataFrame:
        return self._current(self._read("postings", self._holding())).drop("seq")

    def members(self) -> DataFrame:
        """``collection_id, doc_id`` of every document in the index, those without chunks too."""
        return self._current(self._read("keys", self._holding())).where("live").select(*KEY)

    def terms(self, spark: SparkSession | None = None) -> DataFrame:
        """``collection_id, term, df``: sums of signed counts. Filters on either column reach the scans."""
        counts = self._uncleared(self._read("terms", self._holding()))
        return counts.groupBy("collection_id", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self, spark: SparkSession | None = None) -> DataFrame:
        """``collection_id, n_chunks, avg_dl``."""
        counts = self._uncleared(self._read("stats", self._holding())).groupBy("collection_id").agg(
            F.sum("n_chunks").alias("n_chunks"), F.sum("total_dl").alias("_dl"))
        return counts.where("n_chunks > 0").select("collection_id", "n_chunks", (F.col("_dl") / F.col("n_chunks")).alias("avg_dl"))


class SearchStore:
    """The index under a folder that all executors share. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, base: ChunkIndex | None = None) -> SearchStore:
        """A new store, empty or over a stored index, whose files become the first segment and are not changed."""
        store = cls(spark, root)
        store._commit(0, () if base is None else (Segment(0, base.path, "base"),), -1)
        return store

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an earlier one."""
        found = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest")
        if version is not None:
            found = found.where(F.col("version") == version)
        row = found.orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no such version under {self.root}")
        return Snapshot(self.spark, row["version"], tuple(Segment(*s) for s in row["segments"] or ()), row["batch"])

    def _commit(self, version: int, segments: tuple[Segment, ...], batch: int) -> None:
        row = json.dumps({"segments": [vars(s) for s in segments], "batch": batch})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(f"{self.root}/manifest/version={version}")

    def _new_segment(self, seq: int) -> str:
        # A path of its own for each attempt: what a failed one left is never named by a version.
        return f"{self.root}/segments/{seq:08d}-{uuid.uuid4().hex}"

    def put(self, docs: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> Snapshot:
        """Set documents (``collection_id, doc_id, text``; one row each) and remove others (``collection_id, doc_id``).

        A document's old chunks go, also if its new text has none. A document in both is set. With a ``batch`` number, one that went in
        before, or a smaller one, changes nothing, so a repeated streaming batch counts once.
        """
        now = self.snapshot()
        if batch is not None and batch <= now.batch:
            return now
        seq, spark = now.version + 1, self.spark
        path = self._new_segment(seq)
        text = docs.select(F.col("collection_id").cast("string"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        text.write.parquet(f"{path}/texts")
        # Everything below is derived from the stored texts, so a table that changes meanwhile cannot part them.
        stored = spark.read.schema(text.schema).parquet(f"{path}/texts")
        keys = stored.select(*KEY, F.lit(True).alias("live"))
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col("collection_id").cast("string"), F.col("doc_id").cast("bigint"), F.lit(False).alias("live")))
        keys.groupBy(*KEY).agg(F.max("live").alias("live")).write.parquet(f"{path}/keys")
        touched = spark.read.schema(_SCHEMAS["keys"]).parquet(f"{path}/keys")
        write_chunks(search.chunk(stored, "doc_id", "collection_id", "text"), f"{path}/chunks")
        fresh = spark.read.schema(_SCHEMAS["chunks"]).parquet(f"{path}/chunks").select(*CHUNK_COLUMNS)
        old = _of_keys(now.bucketed_chunks(), touched)
        signed = fresh.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        signed.groupBy("collection_id").agg(F.sum("sign").cast("bigint").alias("n_chunks"), F.sum(F.col("sign") * F.col("dl")).cast("bigint").alias("total_dl")) \
            .write.parquet(f"{path}/stats")
        _write_by_term(search.term_counts(fresh), "postings", path)
        counted = search.term_counts(signed, keep=("sign",))
        _write_by_term(counted.groupBy("collection_id", "term").agg(F.sum("sign").cast("bigint").alias("df")).where("df <> 0"), "terms", path)
        self._commit(now.version + 1, (*now.segments, Segment(seq, path, "batch")), now.batch if batch is None else batch)
        return self.snapshot()

    def clear(self, collection_id: str) -> Snapshot:
        """Remove a collection from chunks, postings, counts and memberships in one step."""
        now = self.snapshot()
        seq = now.version + 1
        path = self._new_segment(seq)
        self.spark.createDataFrame([(collection_id,)], _SCHEMAS["cleared"]).coalesce(1).write.parquet(f"{path}/cleared")
        self._commit(seq, (*now.segments, Segment(seq, path, "clear")), now.batch)
        return self.snapshot()

    def compact(self) -> Snapshot:
        """Fold all segments into one. Earlier versions stay readable."""
        now = self.snapshot()
        seq = now.version + 1
        path = self._new_segment(seq)
        write_chunks(now.chunks(), f"{path}/chunks")
        now.members().select(*KEY, F.lit(True).alias("live")).write.parquet(f"{path}/keys")
        stored = self.spark.read.schema(_SCHEMAS["chunks"]).parquet(f"{path}/chunks")
        search.corpus_stats(stored).select("collection_id", "n_chunks", "total_dl").write.parquet(f"{path}/stats")
        _write_by_term(now.postings(), "postings", path)
        _write_by_term(now.terms(), "terms", path)
        self._commit(seq, (Segment(seq, path, "base"),), now.batch)
        return self.snapshot()


def _of_keys(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored chunks of some documents. The join takes the bucket too, so that only the keys' directories are read."""
    wanted = keys.select(*KEY, bucket_of(F.col("collection_id")).alias("bucket")).where("bucket >= 0")
    return chunks.join(wanted, [*KEY, "bucket"], "left_semi").select(*CHUNK_COLUMNS)


def _write_by_term(rows: DataFrame, name: str, path: str) -> None:
    """Clustered by term, so that a query's terms are a few row groups; a term of very many chunks spreads by document."""
    order = ("term", "collection_id", "doc_id") if name == "postings" else ("term", "collection_id")
    columns = [c.split()[0] for c in _SCHEMAS[name].split(", ")]
    rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
