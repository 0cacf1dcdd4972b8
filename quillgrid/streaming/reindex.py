"""Re-indexing changed documents in every collection that holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.sources.search_store import KEY, SearchStore


def latest_text(changes: DataFrame, memberships: DataFrame) -> DataFrame:
    """``collection_id, doc_id, text`` of changed documents, one row per collection holding them.

    Structured text replaces raw text once it exists. Of several changes to a document the last one counts, of those at one time the one
    with the greatest hash of its text. Only keys, times and hashes are aggregated; texts are joined to what is left. Memberships hold
    ``collection_id, doc_id``.
    """
    text = F.coalesce(F.nullif("structured_json", F.lit("")), F.col("raw_content"), F.lit(""))
    rows = changes.select("doc_id", text.alias("text"), F.struct("changed_at", F.xxhash64(text).alias("mix")).alias("_at"))
    last = rows.groupBy("doc_id").agg(F.max("_at").alias("_at"))
    one = rows.join(last, ["doc_id", "_at"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    return one.join(memberships.select(*KEY).distinct(), "doc_id").select(*KEY, "text")


def reindex(
    changes: DataFrame, store: SearchStore, checkpoint: str, memberships: Callable[[], DataFrame] | None = None
) -> StreamingQuery:
    """Process what has arrived; each batch becomes one version of the store, and a repeated batch changes nothing.

    Memberships are read anew for every batch: those given, or else the store's own. A change to a document that no collection holds is
    passed over.
    """
    def write(batch_df: DataFrame, batch: int) -> None:
        members = memberships() if memberships is not None else store.snapshot().members()
        store.put(latest_text(batch_df, members), batch=batch)

    return (
        changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
