"""Retrieval: chunks, postings, corpus statistics, BM25 ranking, line search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.functions.core import lines_of, run_counts, trim_ws, unfold
from quillgrid.functions.text import chunk_pieces, pack_pieces, tokenize
from quillgrid.session import materialise

CHUNK_KEY = ("collection_id", "doc_id", "position")
#: Equal tokens beside each other, in sorted tokens joined by blanks; possessive, so that the matcher stays iterative.
TOKEN_RUN = r"([^ ]++)(?: \1(?![^ ]))*+"
RANKED_SCHEMA = (
    "query_id string, collection_id string, rank int, doc_id bigint, position int, score double"
)


def chunk(df: DataFrame, doc: str, collection: str, text: str, size: int = K.CHUNK_BYTES) -> DataFrame:
    """One row per chunk: ``collection_id, doc_id, position, content``."""
    # The pieces are a column of their own so that the fold reads them instead of recomputing them.
    pieces = df.select(
        F.col(collection).alias("collection_id"), F.col(doc).alias("doc_id"),
        chunk_pieces(F.col(text), size).alias("_pieces"),
    )
    return unfold(
        pieces, ["collection_id", "doc_id"], pack_pieces(F.col("_pieces"), size), "position", "content"
    )


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Adds ``tokens`` and their number ``dl``, stored once instead of derived per query."""
    return chunks.withColumn("tokens", tokenize(F.col("content"))).withColumn("dl", F.size("tokens"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and average length per collection; chunks without tokens count."""
    return chunks.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl"), F.sum("dl").cast("bigint").alias("total_dl")
    )


def term_counts(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings: one row per (chunk, term) with its frequency, and further columns to keep.

    Counting happens inside the row, so no shuffle is needed: a chunk's sorted tokens are joined by blanks, which no token holds, and cut
    where the token changes. A run's length gives the frequency. All of it is compiled; functions over array items are not.
    """
    joined = F.array_join(F.sort_array("tokens"), " ")
    runs = F.regexp_extract_all(joined, F.lit(TOKEN_RUN), F.lit(0))
    listed = unfold(chunks, [*CHUNK_KEY, "dl", *keep], runs, "_i", "_run").withColumn("term", F.substring_index("_run", " ", 1))
    return listed.select(
        *CHUNK_KEY, "dl", *keep, "term", ((F.length("_run") + 1) / (F.length("term") + 1)).cast("int").alias("tf")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    """Chunks per (collection, term)."""
    return postings.groupBy("collection_id", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: Iterable[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Terms and their repetitions for each query text; texts without terms give none."""
    import re

    out: dict[str, dict[str, int]] = {}
    for name, text in queries:
        terms: dict[str, int] = {}
        for term in re.findall(K.TOKEN, text.lower()):
            terms[term] = terms.get(term, 0) + 1
        out[name] = terms
    return out


def matches(chunks: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Chunks holding at least one wanted term: ``hits`` maps each to its frequency.

    A map-only scan: a chunk's tokens are tested in place, and only matching chunks go on.
    """
    wanted = sorted(set(terms))
    if not wanted:
        raise ValueError("no query terms")
    literal = F.array(*[F.lit(t) for t in wanted])
    kept = F.filter(F.col("tokens"), lambda t: F.array_contains(literal, t))
    hits = F.transform(run_counts(kept), lambda r: F.struct(r["value"].alias("term"), r["n"].alias("tf")))
    # The overlap test is cheap and reaches the scan; frequencies are counted for what is left.
    found = chunks.where(F.arrays_overlap(F.col("tokens"), literal))
    return found.withColumn("hits", hits).drop("tokens")


def term_gain(tf: Column, df: Column, dl: Column, n_chunks: Column, avg_dl: Column) -> Column:
    """What one occurrence of a query term adds to the score of a chunk."""
    idf = F.log((n_chunks - df + 0.5) / (df + 0.5) + 1)
    norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avg_dl)
    return idf * (tf * (K.BM25_K1 + 1)) / (tf + norm)


def top_chunks(scored: DataFrame, k: int) -> DataFrame:
    """Ranks chunks within (query, collection) and keeps the ``k`` best; ties go to (doc, position).

    ``rank <= k`` is a window group limit: each task passes on at most k rows per group, so one
    collection holding most chunks does not gather them in one task.
    """
    order = Window.partitionBy("query_id", "collection_id").orderBy(F.desc(F.round("score", 9)), "doc_id", "position")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if k > 0:
        ranked = ranked.where(F.col("rank") <= k)
    columns = ["query_id", "collection_id", "rank", "doc_id", "position", "score"]
    return ranked.select(*columns, *[c for c in scored.columns if c not in columns])


def bm25(
    chunks: DataFrame, queries: Iterable[tuple[str, str]], k: int,
    stats: DataFrame | None = None, compat: bool = False,
) -> DataFrame:
    """The ``k`` best chunks per (query, collection); ``k <= 0`` keeps all with a positive score.

    For chunks that are not indexed: ``collection_id, doc_id, position, content, tokens, dl``. A first
    pass over the tokens counts the asked terms per collection and writes that small table; the second
    keeps matching chunks only and scores them in place. The written table's true size decides how it
    is joined: broadcast while small, else a shuffle in which Spark splits skewed collections.

    A repeated query term weighs by its repetitions. With ``compat``, repetitions also multiply the
    document frequency, and a term that thereby turns a score non-positive drops the chunk.
    """
    asked = query_terms(queries)
    terms = sorted({t for q in asked.values() for t in q})
    spark = chunks.sparkSession
    if not terms:
        return spark.createDataFrame([], RANKED_SCHEMA + ", content string")

    corpus = (stats if stats is not None else corpus_stats(chunks)).select(
        "collection_id", "n_chunks", "avg_dl"
    )
    found = matches(chunks, terms)
    frequency = (
        unfold(found, ["collection_id"], F.col("hits.term"), "_i", "term")
        .groupBy("collection_id", "term")
        .agg(F.count(F.lit(1)).alias("df"))
        # At most one entry per query term: the group is bounded by the query.
        .groupBy("collection_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df_of"))
    )
    known = materialise(frequency.join(corpus, "collection_id"), "frequencies")
    weights = F.array(
        *[
            F.struct(
                F.lit(name).alias("query_id"),
                F.create_map(*[x for t, n in q.items() for x in (F.lit(t), F.lit(n))]).alias("qtf"),
            )
            for name, q in asked.items() if q
        ]
    )

    def gain(hit: Column, qtf: Column) -> Column:
        times = F.coalesce(F.try_element_at(qtf, hit["term"]), F.lit(0))
        df = F.try_element_at(F.col("df_of"), hit["term"])
        if compat:
            df = df * times
        one = term_gain(hit["tf"], df, F.col("dl"), F.col("n_chunks"), F.col("avg_dl"))
        return F.when(times == 0, F.lit(0.0)).otherwise(times * one)

    def score(w: Column) -> Column:
        gains = F.transform(F.col("hits"), lambda h: gain(h, w["qtf"]))
        return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)

    scores = F.transform(weights, lambda w: F.struct(w["query_id"], score(w).alias("score")))
    scored = (
        unfold(found.join(known, "collection_id"), [*CHUNK_KEY, "content"], scores, "_i", "s")
        .select("s.query_id", *CHUNK_KEY, "s.score", "content")
        .where(F.col("score") > 0)
    )
    return top_chunks(scored, k)


def with_names(hits: DataFrame, names: DataFrame, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """Adds ``doc_name``; documents without a name show as ``doc#<id>``.

    ``hits`` should be a stored table: it is read twice, first to cut the names down to the documents
    hit, which spares the name table a shuffle while the hits are small enough to broadcast.
    """
    hit_docs = hits.select("doc_id").distinct()
    known = names.select(F.col(doc).alias("doc_id"), F.col(name).alias("_name")).join(
        hit_docs, "doc_id", "left_semi"
    )
    shown = F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.concat(F.lit("doc#"), F.col("doc_id").cast("string")))
    return hits.join(known, "doc_id", "left").withColumn("doc_name", shown).drop("_name")


def format_hit(rank: Column, name: Column, score: Column) -> Column:
    return F.format_string("--- [%d] %s (relevance: %.2f) ---", rank, name, score)


def grep(
    df: DataFrame, doc: str, raw: str, structured: str | None, needle: str, cap: int | None = None
) -> DataFrame:
    """Case-insensitive literal search in the lines of raw and structured text.

    Hits keep document order, raw before structured; ``hit`` numbers them, and ``cap`` keeps the first of each
    document if it is given. Both texts of a document are in its row, so lines are numbered, filtered and cut there.
    """
    schema = "doc_id bigint, hit int, source string, line int, text string"
    if needle == "":
        return df.sparkSession.createDataFrame([], schema)
    wanted = F.lit(needle.lower())

    def hits(text: str, source: str) -> Column:
        numbered = F.transform(
            lines_of(F.coalesce(F.col(text), F.lit(""))),
            lambda l, i: F.struct(F.lit(source).alias("source"), (i + 1).alias("line"), l.alias("text")),
        )
        return F.filter(numbered, lambda h: F.contains(F.lower(h["text"]), wanted))

    found = hits(raw, "raw")
    if structured is not None:
        found = F.concat(found, hits(structured, "structured"))
    present = F.contains(F.lower(F.col(raw)), wanted)
    if structured is not None:
        present = present | F.contains(F.lower(F.col(structured)), wanted)
    return (
        unfold(df.where(present), [F.col(doc).alias("doc_id")], found if cap is None else F.slice(found, 1, cap), "hit", "h")
        .select(
            "doc_id", (F.col("hit") + 1).alias("hit"), "h.source", "h.line", trim_ws(F.col("h.text")).alias("text")
        )
    )


def highlight(text: Column, needle: str) -> Column:
    """``struct<before, match, after>`` around the first case-insensitive match."""
    at = F.locate(needle.lower(), F.lower(text))
    n = len(needle)
    if n == 0:
        at = F.lit(0)
    return F.when(
        at > 0,
        F.struct(
            F.substring(text, F.lit(1), at - 1).alias("before"),
            F.substring(text, at, F.lit(n)).alias("match"),
            F.substring(text, at + n, F.length(text)).alias("after"),
        ),
    ).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


__all__ = [
    "bm25", "chunk", "corpus_stats", "document_frequency", "format_hit", "grep", "highlight",
    "matches", "query_terms", "term_counts", "term_gain", "top_chunks", "with_names", "with_tokens",
]
