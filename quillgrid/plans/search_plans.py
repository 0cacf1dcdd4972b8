"""Queries over chunks: statistics, frequencies, ranking, the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid import constants as K
from quillgrid.operators import search
from quillgrid.plans import derived as D
from quillgrid.plans.registry import query
from quillgrid.plans.text_plans import chunks_sql
from quillgrid.session import materialise, run_dir
from quillgrid.sources import chunk_index
from quillgrid.sources.search_store import SearchStore

DEPTH = 10
QUERIES = (("three terms", "the then with"), ("repeats", "there there of"), ("rare", "Entre VERDAD x9"))

_CHUNKS: dict[tuple[str, str], chunk_index.ChunkIndex] = {}
_INDEXES: dict[tuple[str, str], chunk_index.ChunkIndex] = {}


def _sources(spark, sf):
    return D.documents(spark, sf).select("doc_id", "source", "text")


def stored_chunks(spark, sf) -> chunk_index.ChunkIndex:
    """The chunks of the index, written once per application and data set, for queries that read nothing else of it.

    They live in the shared folder, so losing an executor loses nothing of them.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CHUNKS:
        _CHUNKS[key] = chunk_index.build_chunks(_sources(spark, sf), "doc_id", "source", "text", run_dir(spark, "chunks"))
    return _CHUNKS[key]


def index(spark, sf) -> chunk_index.ChunkIndex:
    """The stored chunk index of the documents, from the stored chunks, also written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        keys = chunk_index.document_keys(_sources(spark, sf), "doc_id", "source")
        _INDEXES[key] = chunk_index.add_postings(spark, stored_chunks(spark, sf), keys)
    return _INDEXES[key]


def _chunks(spark, sf):
    """Chunks straight from the documents, for queries that need them once."""
    return search.with_tokens(search.chunk(D.documents(spark, sf), "doc_id", "source", "text"))


CHUNKS = chunks_sql("documents")


def tokens_sql(docs: str) -> str:
    return f"""{chunks_sql(docs)}, tokened AS (SELECT *, regexp_extract_all(lower(content), '{K.TOKEN}') AS ts FROM chunks),
postings AS (SELECT collection_id, doc_id, position, term, count(*) AS tf FROM (SELECT collection_id, doc_id, position, unnest(ts) AS term FROM tokened) GROUP BY ALL),
corpus AS (SELECT collection_id, count(*) AS n_chunks, avg(len(ts)) AS avg_dl FROM tokened GROUP BY collection_id)"""


TOKENS = tokens_sql("documents")


@query("bm25_stats", f"WITH {TOKENS} SELECT collection_id, n_chunks, round(avg_dl, 6) AS avg_dl FROM corpus")
def bm25_stats(spark, sf):
    stats = search.corpus_stats(_chunks(spark, sf))
    return stats.select("collection_id", "n_chunks", F.round("avg_dl", 6).alias("avg_dl"))


@query("bm25_df", f"WITH {TOKENS} SELECT collection_id, term, count(*) AS df FROM postings GROUP BY ALL")
def bm25_df(spark, sf):
    return search.document_frequency(search.term_counts(_chunks(spark, sf)))


@query("bm25_tf", f"WITH {TOKENS} SELECT collection_id, doc_id, position, term, tf FROM postings")
def bm25_tf(spark, sf):
    return search.term_counts(_chunks(spark, sf)).drop("dl")


_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{t}', {n})" for name, q in search.query_terms(QUERIES).items() for t, n in q.items()
) + ") AS v(query_id, term, qtf))"


def scored_sql(docs: str) -> str:
    return f"""{tokens_sql(docs)}, {_ASKED}, dfs AS (SELECT collection_id, term, count(*) AS df FROM postings GROUP BY ALL),
scored AS (
  SELECT a.query_id, p.collection_id, p.doc_id, p.position,
    sum(a.qtf * ln((n_chunks - df + 0.5) / (df + 0.5) + 1) * (tf * {K.BM25_K1 + 1}) / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * len(t.ts) / avg_dl))) AS score
  FROM asked a JOIN postings p USING (term) JOIN dfs USING (collection_id, term) JOIN corpus USING (collection_id)
    JOIN tokened t ON t.collection_id = p.collection_id AND t.doc_id = p.doc_id AND t.position = p.position
  GROUP BY ALL),
ranked AS (
  SELECT s.*, content, row_number() OVER (PARTITION BY query_id, s.collection_id ORDER BY round(score, 9) DESC, s.doc_id, s.position) AS rank
  FROM scored s JOIN chunks c ON c.collection_id = s.collection_id AND c.doc_id = s.doc_id AND c.position = s.position WHERE score > 0)"""


_SCORED = scored_sql("documents")


def _hits(spark, sf):
    return materialise(chunk_index.ranked(spark, index(spark, sf), QUERIES, DEPTH), "ranked")


TOP = f"""WITH {_SCORED} SELECT query_id, collection_id, rank, doc_id, position, round(score, 6) AS score, content
FROM ranked WHERE rank <= {DEPTH}"""


@query("bm25_topk", TOP)
def bm25_topk(spark, sf):
    """From the stored postings."""
    found = chunk_index.search_index(spark, index(spark, sf), QUERIES, DEPTH)
    return found.withColumn("score", F.round("score", 6))


@query("bm25_scan", TOP)
def bm25_scan(spark, sf):
    """The same ranking from chunks that have no postings."""
    stored = index(spark, sf)
    found = search.bm25(stored.chunks(spark), QUERIES, DEPTH, stats=stored.stats(spark))
    return found.withColumn("score", F.round("score", 6))


@query(
    "hit_names",
    f"""WITH {_SCORED} SELECT query_id, r.collection_id, rank, CASE WHEN r.doc_id % 5 = 0 THEN 'doc#' || r.doc_id ELSE lang || '-' || r.doc_id || '.txt' END AS doc_name
FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= {DEPTH}""",
)
def hit_names(spark, sf):
    return search.with_names(_hits(spark, sf), _names(spark, sf)).select(
        "query_id", "collection_id", "rank", "doc_name"
    )


def _names(spark, sf):
    """File names of the documents; every fifth has none."""
    name = F.when(F.col("doc_id") % 5 == 0, "").otherwise(
        F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return D.table(spark, sf, "documents").select("doc_id", name.alias("name"))


@query(
    "hit_format",
    f"""WITH {_SCORED} SELECT query_id, r.collection_id, format('--- [{{}}] {{}} (relevance: {{:.2f}}) ---', rank,
  CASE WHEN r.doc_id % 5 = 0 THEN 'doc#' || r.doc_id ELSE lang || '-' || r.doc_id || '.txt' END, round(score, 6)) AS line
FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= {DEPTH}""",
)
def hit_format(spark, sf):
    named = search.with_names(_hits(spark, sf), _names(spark, sf))
    return named.select(
        "query_id", "collection_id",
        search.format_hit(F.col("rank"), F.col("doc_name"), F.round("score", 6)).alias("line"),
    )


@query(
    "chunk_scan",
    f"WITH {CHUNKS} SELECT doc_id, position, content FROM chunks WHERE collection_id = 'src3'",
)
def chunk_scan(spark, sf):
    return stored_chunks(spark, sf).collection(spark, "src3").select("doc_id", "position", "content")


@query(
    "bm25_collection",
    f"""WITH {_SCORED} SELECT query_id, collection_id, rank, doc_id, position, round(score, 6) AS score, content
FROM ranked WHERE rank <= {DEPTH} AND collection_id = 'src3'""",
)
def bm25_collection(spark, sf):
    """Search in one collection: only its postings and its directory of chunks are read."""
    found = chunk_index.search_index(spark, index(spark, sf), QUERIES, DEPTH, ["src3"])
    return found.withColumn("score", F.round("score", 6))


_CHANGED = "doc_id % 7 = 3"
_NEW_TEXT = "'Replaced text of document ' || CAST(doc_id AS STRING) || '. ' || lang || ' again.'"


def _store(spark, sf) -> SearchStore:
    """A store of its own over the shared index, whose files stay as they are."""
    return SearchStore.create(spark, run_dir(spark, "store"), index(spark, sf))


def _new_texts(spark, sf):
    return D.documents(spark, sf).where(_CHANGED).select("doc_id", F.col("source").alias("collection_id"), F.expr(_NEW_TEXT).alias("text"))


@query(
    "index_replace",
    f"""WITH {CHUNKS} SELECT collection_id, doc_id, position, content FROM chunks WHERE NOT {_CHANGED}
UNION ALL SELECT source, doc_id, 0, {_NEW_TEXT} FROM documents WHERE {_CHANGED}""",
)
def index_replace(spark, sf):
    """Every seventh document changes; all its chunks are replaced."""
    return _store(spark, sf).put(_new_texts(spark, sf)).chunks().select("collection_id", "doc_id", "position", "content")


@query("clear_collection", f"WITH {CHUNKS} SELECT collection_id, doc_id, position FROM chunks WHERE collection_id <> 'src1'")
def clear_collection(spark, sf):
    return _store(spark, sf).clear("src1").chunks().select("collection_id", "doc_id", "position")


#: The documents after three changes: new texts, emptied and removed documents, and a collection cleared and begun anew.
_EDITED = f"""SELECT doc_id, source, CASE WHEN {_CHANGED} THEN {_NEW_TEXT} WHEN doc_id % 11 = 5 THEN '' ELSE text END AS text
FROM documents WHERE source <> 'src1' AND doc_id % 13 <> 6
UNION ALL SELECT doc_id, source, 'the then of there ' || lang FROM documents WHERE source = 'src1' AND doc_id % 5 = 0"""


def _edited_store(spark, sf) -> SearchStore:
    docs = D.documents(spark, sf).select("doc_id", F.col("source").alias("collection_id"), "lang", "text")
    store = _store(spark, sf)
    emptied = docs.where(f"doc_id % 11 = 5 AND NOT ({_CHANGED})").withColumn("text", F.lit(""))
    store.put(_new_texts(spark, sf).unionByName(emptied.drop("lang")))
    store.clear("src1")
    again = docs.where("collection_id = 'src1' AND doc_id % 5 = 0").withColumn("text", F.concat(F.lit("the then of there "), "lang"))
    store.put(again, removed=docs.where("collection_id <> 'src1' AND doc_id % 13 = 6"))
    return store


@query(
    "search_after_changes",
    f"""WITH edited AS ({_EDITED}), {scored_sql("edited")} SELECT query_id, collection_id, rank, doc_id, position, round(score, 6) AS score, content
FROM ranked WHERE rank <= {DEPTH}""",
)
def search_after_changes(spark, sf):
    """The ranking of a changed index is that of an index built anew."""
    found = chunk_index.search_index(spark, _edited_store(spark, sf).snapshot(), QUERIES, DEPTH)
    return found.withColumn("score", F.round("score", 6))


@query(
    "index_members",
    f"""WITH edited AS ({_EDITED}), {tokens_sql("edited")},
c AS (SELECT collection_id, doc_id, count(*) AS n_chunks FROM chunks GROUP BY ALL),
p AS (SELECT collection_id, doc_id, count(*) AS n_postings FROM postings GROUP BY ALL)
SELECT source AS collection_id, e.doc_id, COALESCE(n_chunks, 0) AS n_chunks, COALESCE(n_postings, 0) AS n_postings
FROM edited e LEFT JOIN c ON c.collection_id = source AND c.doc_id = e.doc_id LEFT JOIN p ON p.collection_id = source AND p.doc_id = e.doc_id""",
)
def index_members(spark, sf):
    """Memberships, chunks and postings of one version agree, after replacements, a clear and a compaction."""
    now = _edited_store(spark, sf).compact()
    key = ["collection_id", "doc_id"]
    chunks = now.chunks().groupBy(*key).agg(F.count(F.lit(1)).alias("n_chunks"))
    postings = now.postings().groupBy(*key).agg(F.count(F.lit(1)).alias("n_postings"))
    return now.members().join(chunks, key, "left").join(postings, key, "left").na.fill(0, ["n_chunks", "n_postings"])
