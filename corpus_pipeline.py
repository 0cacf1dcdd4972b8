"""The corpus pipeline: documents that a training set keeps, packed into sequences.

Five stages, each written as Parquet and read again as the next one's documents. The first four return the columns of ``documents``; the
last one returns the packed pieces. Rows of one id count as one document in decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from quillgrid.llm.common import hinted, materialise, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.is_held_out())
    scored = toxicity.score(docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(docs.columns) if c != "text"}), model)
    return scored.where("predicted = 0").select(*[F.col(c if c == "text" else f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    found = materialise(jaccard_join.similar(docs), "classes")
    gone = materialise(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(hinted(gone), docs["doc_id"] == F.col("_gone"), "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that an earlier document holds; what is left of a cut character goes too.

    A text that is repeated from end to end leaves with its document; others keep theirs, empty ones included.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = suffix_dedup.dedup(docs, with_kept=True, carry=others)
    done = done.where("n_bytes = 0 or n_removed < n_bytes").withColumn("n_chars", F.length("kept_text").cast("long"))
    return done.withColumnRenamed("kept_text", "text").select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


def _prepared(stage):
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("ngram_jaccard_join", _prepared(drop_near_copies)),
    ("suffix_array_dedup", _prepared(drop_repeated_passages)),
    ("benchmark_decontamination", _prepared(drop_benchmark_copies)),
    ("best_fit_packing", _prepared(pack_sequences)),
]

#: SQL cannot express the classifier, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
