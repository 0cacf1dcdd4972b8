"""Streaming queries: each runs to the end of what is available and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.operators import collections
from quillgrid.operators.search import CHUNK_KEY
from quillgrid.plans import derived as D
from quillgrid.plans import search_plans
from quillgrid.plans.registry import query
from quillgrid.plans.text_plans import chunks_sql
from quillgrid.session import run_dir
from quillgrid.sources import chunk_index
from quillgrid.sources.files import table
from quillgrid.sources.search_store import SearchStore
from quillgrid.streaming import ingest, milestones, reindex


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table as a stream of its files; the table is one file or a folder of files."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@query(
    "stream_ingest",
    f"""WITH {D.CSV_CELLS_SQL},
kinds AS (SELECT doc_id, position, CASE WHEN lower(value) IN {D.MISSING_SQL} THEN NULL ELSE {D.classify_sql('value')} END AS kind, value FROM csv_cells)
SELECT doc_id, 'csv' AS doc_type, max(n) AS row_count, 6 AS field_count, (SELECT count(*) FROM csv_cells c WHERE c.doc_id = r.doc_id AND value = '') AS empty_values
FROM csv_records r GROUP BY doc_id""",
)
def stream_ingest(spark, sf):
    """Delimited documents are analysed as they arrive."""
    root = run_dir(spark, "ingest")
    D.csv_docs(spark, sf).select("doc_id", F.col("text").alias("raw_content")).write.parquet(f"{root}/in")
    docs = spark.readStream.schema("doc_id bigint, raw_content string").parquet(f"{root}/in")
    (
        ingest.analyse(docs).writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{root}/out").select(
        "doc_id", "doc_type", "row_count", "field_count", F.col("clean.empty_values").alias("empty_values")
    )


def _changed_store(spark, sf) -> SearchStore:
    """An index of old texts of the documents after three batches of changes, which bring all to the texts of today."""
    root = run_dir(spark, "reindex")
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    old = docs.withColumn("text", F.expr("CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '' ELSE 'Old ' || left(text, 40) END"))
    store = SearchStore.create(spark, f"{root}/store", chunk_index.build_index(old, "doc_id", "source", "text", f"{root}/base"))
    schema = "doc_id bigint, raw_content string, structured_json string, changed_at timestamp_ntz"
    for n in (1, 2, 3):
        # What has arrived since the last run is one batch, in as many files as the documents are read by tasks.
        docs.where(F.col("doc_id") % 4 == n).select(
            "doc_id", F.col("text").alias("raw_content"), F.lit("").alias("structured_json"), F.lit(f"2024-01-0{n}").cast("timestamp_ntz").alias("changed_at"),
        ).write.parquet(f"{root}/changes/n={n}")
        changes = spark.readStream.schema(schema).parquet(f"{root}/changes/*")
        reindex.reindex(changes, store, f"{root}/checkpoint").awaitTermination()
    return store


@query("stream_reindex", f"WITH {chunks_sql('documents')} SELECT collection_id, doc_id, position, content FROM chunks")
def stream_reindex(spark, sf):
    """Changed documents are chunked again for every collection they belong to."""
    return _changed_store(spark, sf).snapshot().chunks().select(*CHUNK_KEY, "content")


@query("stream_search", search_plans.TOP)
def stream_search(spark, sf):
    """A ranking sees what was indexed again: postings, frequencies and lengths follow each batch."""
    snapshot = _changed_store(spark, sf).snapshot()
    found = chunk_index.search_index(spark, snapshot, search_plans.QUERIES, search_plans.DEPTH)
    return found.withColumn("score", F.round("score", 6))


_ACTIONS = {"view": "first_upload", "signup": "structured", "purchase": "schema_master", "click": "queried"}
_KEY = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in _ACTIONS.items()) + " END"


@query(
    "stream_milestones",
    f"SELECT user_id AS session, {_KEY} AS milestone, min(ts) AS earned_at FROM events WHERE event_type <> 'error' GROUP BY ALL",
)
def stream_milestones(spark, sf):
    root = run_dir(spark, "milestones")
    events = milestones.milestone_events(_stream(spark, sf, "events"), "user_id", "event_type", "ts", _ACTIONS)
    milestones.run(events, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return milestones.earned(spark, f"{root}/out").withColumn("earned_at", F.col("earned_at").cast("timestamp_ntz"))


@query(
    "stream_milestones_in_order",
    f"""WITH firsts AS (SELECT user_id AS session, {_KEY} AS milestone, min(ts) AS earned_at FROM events WHERE event_type <> 'error' GROUP BY ALL),
fifth AS (SELECT user_id AS session, '{K.POWER_USER}' AS milestone, ts AS earned_at FROM (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'view') WHERE n = {K.POWER_USER_DOCUMENTS}),
every AS (SELECT * FROM firsts UNION ALL SELECT * FROM fifth)
SELECT session, milestone, earned_at, row_number() OVER (PARTITION BY session ORDER BY earned_at, milestone) AS place FROM every""",
)
def stream_milestones_in_order(spark, sf):
    """Five batches of events, in no order of time; the milestone of several documents among them."""
    root = run_dir(spark, "milestones")
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", F.pmod(F.xxhash64("event_id"), F.lit(5)).alias("part"))
    for n in range(5):
        events.where(F.col("part") == n).drop("part").write.parquet(f"{root}/in/n={n}")
        stream = spark.readStream.schema("user_id bigint, event_type string, ts timestamp_ntz").parquet(f"{root}/in/*")
        found = milestones.milestone_events(stream, "user_id", "event_type", "ts", _ACTIONS, power_action="view")
        milestones.run(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    earned = milestones.earned(spark, f"{root}/out").withColumn("earned_at", F.col("earned_at").cast("timestamp_ntz"))
    return collections.in_order(earned)
