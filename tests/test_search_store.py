"""The changing index against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import search
from quillgrid.session import run_dir
from quillgrid.sources import chunk_index
from quillgrid.sources.search_store import SearchStore

DOCS = "collection_id string, doc_id bigint, text string"
ASKED = [("x", "go the"), ("y", "slow slow data"), ("z", "nothing")]


def text(rng):
    return " ".join(rng.choice("go is a programming language python data the the slow".split()) for _ in range(rng.randint(0, 260)))


def frame(spark, docs):
    return spark.createDataFrame([(*k, t) for k, t in docs.items()], DOCS)


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def assert_as_new(spark, store, docs, k=5):
    """Ranking, chunks, counts and members are those of an index of ``docs``."""
    now = store.snapshot()
    fresh = chunk_index.build_index(frame(spark, docs), "doc_id", "collection_id", "text", run_dir(spark, "fresh"))
    ranking = ("query_id", "collection_id", "rank", "doc_id", "position", "score", "content")
    assert rows(chunk_index.search_index(spark, now, ASKED, k), *ranking) == rows(chunk_index.search_index(spark, fresh, ASKED, k), *ranking)
    for name, columns in {"chunks": search.CHUNK_KEY + ("content", "dl"), "postings": ("term", *search.CHUNK_KEY, "tf", "dl"),
                          "terms": ("collection_id", "term", "df"), "stats": ("collection_id", "n_chunks", "avg_dl")}.items():
        assert rows(getattr(now, name)(spark), *columns) == rows(getattr(fresh, name)(spark), *columns), name
    assert rows(now.members(), "collection_id", "doc_id") == sorted(docs)


@pytest.fixture
def start(spark):
    rng = random.Random(6)
    docs = {(rng.choice("aaab"), i): text(rng) for i in range(24)}
    base = chunk_index.build_index(frame(spark, docs), "doc_id", "collection_id", "text", run_dir(spark, "base"))
    return SearchStore.create(spark, run_dir(spark, "store"), base), docs, rng


def test_batches_clear_and_compaction(spark, start):
    store, docs, rng = start
    assert_as_new(spark, store, docs)
    keys = sorted(docs)
    # New texts, one of them empty, and a document in a new collection.
    change = {keys[0]: text(rng), keys[1]: "  ", keys[2]: text(rng), ("c", 1): "go slow"}
    store.put(frame(spark, change), batch=0)
    docs.update(change)
    assert_as_new(spark, store, docs)
    # A document changes twice, one goes, one that is unknown goes; one is both set and removed.
    change = {keys[0]: "the end", keys[5]: text(rng)}
    gone = [keys[2], keys[5], ("q", 77)]
    store.put(frame(spark, change), spark.createDataFrame(gone, "collection_id string, doc_id bigint"), batch=1)
    docs.update(change)
    del docs[keys[2]]
    before = store.snapshot()
    assert_as_new(spark, store, docs)
    # A repeated batch changes nothing.
    assert store.put(frame(spark, {keys[7]: "other"}), batch=1).version == before.version
    # A cleared collection leaves all tables at once; a reader of the version before still sees it whole.
    store.clear("a")
    kept = {k: t for k, t in docs.items() if k[0] != "a"}
    assert_as_new(spark, store, kept)
    old = store.snapshot(before.version)
    assert rows(old.members(), "collection_id", "doc_id") == sorted(docs)
    assert {r["collection_id"] for r in old.stats().collect()} == {"a", "b", "c"}
    # It can be begun anew.
    again = {("a", 3): "go the go", ("a", 400): "slow"}
    store.put(frame(spark, again), batch=2)
    assert_as_new(spark, store, kept | again)
    now = store.compact()
    assert len(now.segments) == 1 and now.batch == 2
    assert_as_new(spark, store, kept | again)
    store.put(frame(spark, {("a", 3): ""}), batch=3)
    assert_as_new(spark, store, kept | again | {("a", 3): ""})


def test_a_failed_batch_leaves_no_trace(spark, start):
    store, docs, _ = start
    bad = frame(spark, {("a", 0): "x"}).withColumn("text", F.expr("CASE WHEN doc_id = 0 THEN raise_error('lost') END"))
    with pytest.raises(Exception, match="lost"):
        store.put(bad)
    assert_as_new(spark, store, docs)
    # Two writers of one version: the second fails.
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(store.snapshot().version, (), -1)


def test_an_empty_store(spark):
    store = SearchStore.create(spark, run_dir(spark, "store"))
    assert chunk_index.search_index(spark, store.snapshot(), ASKED, 5).count() == 0
    store.put(frame(spark, {("a", 1): "go go", ("b", 1): "go"}))
    assert_as_new(spark, store, {("a", 1): "go go", ("b", 1): "go"})
    with pytest.raises(ValueError):
        store.snapshot(99)


def test_search_in_one_collection(spark, start):
    store, docs, rng = start
    store.put(frame(spark, {("a", 500): "go the slow"}))
    for index in (store.snapshot(), chunk_index.ChunkIndex(store.snapshot().segments[0].path)):
        every = chunk_index.search_index(spark, index, ASKED, 4)
        one = chunk_index.search_index(spark, index, ASKED, 4, ["b"])
        assert rows(one, *one.columns) == rows(every.where("collection_id = 'b'"), *one.columns)
        assert chunk_index.search_index(spark, index, ASKED, 4, []).count() == 0


def test_text_is_read_from_hit_buckets_only(spark, start):
    store, _, _ = start
    index = chunk_index.ChunkIndex(store.snapshot().segments[0].path)
    found = chunk_index.search_index(spark, index, ASKED, 4, ["b"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan
    scan = next(line for line in plan.splitlines() if "content#" in line and "FileScan" in line)
    assert "PushedFilters" in scan and "collection_id" in scan.split("PushedFilters")[1]
    buckets = {r[0] for r in found.select(chunk_index.bucket_of(F.col("collection_id"))).distinct().collect()}
    assert len(buckets) == 1
    postings = chunk_index.ranked(spark, index, ASKED, 4, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(collection_id,b)" in postings or "In(collection_id, [b])" in postings
