import math
import random
import re

from pyspark.sql import functions as F

from quillgrid.operators import search
from quillgrid.session import run_dir
from quillgrid.sources import chunk_index


def chunk_rows(spark, rows):
    df = spark.createDataFrame(rows, "collection_id string, doc_id bigint, position int, content string")
    return search.with_tokens(df)


def naive_bm25(rows, query, k, compat=False):
    """Scores by the formula, one collection at a time."""
    out = []
    tok = lambda s: re.findall("[a-z0-9]+", s.lower())
    for coll in sorted({r[0] for r in rows}):
        chunks = [r for r in rows if r[0] == coll]
        docs = [tok(r[3]) for r in chunks]
        n, avg = len(docs), sum(map(len, docs)) / len(docs)
        terms = tok(query)
        df = {t: sum(t in d for d in docs) * (terms.count(t) if compat else 1) for t in terms}
        ranked = []
        for r, d in zip(chunks, docs):
            s = 0.0
            for t in terms:
                f = d.count(t)
                if f:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    s += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg))
            if s > 0:
                ranked.append((-s, r[1], r[2], coll))
        out += sorted(ranked)[: k or None]
    return {(c, d, p): round(-s, 9) for s, d, p, c in out}


def corpus(seed=4, n=300):
    rng = random.Random(seed)
    words = "go is a programming language python data the the the fast slow".split()
    # One collection holds most chunks.
    return [
        (rng.choice("aaaab"), i // 3, i % 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        for i in range(n)
    ]


def as_scores(df):
    return {(r["collection_id"], r["doc_id"], r["position"]): round(r["score"], 9) for r in df.collect()}


def test_bm25_matches_formula(spark):
    rows = corpus()
    chunks = chunk_rows(spark, rows)
    for query in ("go programming", "the the go", "python"):
        for k in (0, 7):
            for compat in (False, True):
                got = search.bm25(chunks, [("q", query)], k, compat=compat)
                assert as_scores(got) == naive_bm25(rows, query, k, compat), (query, k, compat)


def test_bm25_many_queries_and_empties(spark):
    rows = corpus(9, 60)
    chunks = chunk_rows(spark, rows)
    both = search.bm25(chunks, [("x", "go"), ("y", "data fast"), ("z", " ?! ")], 5)
    assert as_scores(both.where("query_id = 'x'")) == naive_bm25(rows, "go", 5)
    assert as_scores(both.where("query_id = 'y'")) == naive_bm25(rows, "data fast", 5)
    assert both.where("query_id = 'z'").count() == 0
    assert search.bm25(chunks, [("q", "")], 5).count() == 0
    assert search.bm25(chunks, [("q", "zebra violin")], 5).count() == 0


def test_term_counts(spark):
    chunks = chunk_rows(spark, [("a", 1, 0, "b a b"), ("a", 1, 1, "")])
    got = {(r["term"], r["tf"]) for r in search.term_counts(chunks).collect()}
    assert got == {("a", 1), ("b", 2)}


def test_grep(spark):
    df = spark.createDataFrame(
        [(1, "Foo\n barfoo \nx", '{"a":\n"FOO"}'), (2, "\n".join(["foo"] * 30), ""), (3, "none", None)],
        "id bigint, raw string, s string",
    )
    got = [tuple(r) for r in search.grep(df, "id", "raw", "s", "fOO").where("doc_id = 1").orderBy("hit").collect()]
    assert got == [(1, 1, "raw", 1, "Foo"), (1, 2, "raw", 2, "barfoo"), (1, 3, "structured", 2, '"FOO"}')]
    assert search.grep(df, "id", "raw", "s", "foo").where("doc_id = 2").count() == 30
    assert search.grep(df, "id", "raw", "s", "foo", cap=20).where("doc_id = 2").count() == 20
    assert search.grep(df, "id", "raw", "s", "").count() == 0


def test_highlight(column):
    got = column(lambda c: search.highlight(c, "Foo"), ["a fOo b", "none"])
    assert [tuple(r) for r in got] == [("a ", "fOo", " b"), ("none", "", "")]


def test_index_round_trip(spark):
    docs = spark.createDataFrame(
        [(i, "007" if i % 3 else "8", f"word{i}. " * 40) for i in range(12)], "doc_id bigint, c string, text string"
    )
    index = chunk_index.build_index(docs, "doc_id", "c", "text", run_dir(spark, "index"))
    chunks = index.chunks(spark)
    direct = search.with_tokens(search.chunk(docs, "doc_id", "c", "text")).select(*chunks.columns)
    assert chunks.exceptAll(direct).count() == 0 and direct.exceptAll(chunks).count() == 0
    one = index.collection(spark, "007").collect()
    assert [(r["doc_id"], r["position"]) for r in one] == sorted((r["doc_id"], r["position"]) for r in one)
    plan = index.collection(spark, "007")._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert {r["collection_id"] for r in index.stats(spark).collect()} == {"007", "8"}

    new = search.with_tokens(
        search.chunk(spark.createDataFrame([(1, "007", "short")], docs.schema), "doc_id", "c", "text")
    )
    after = chunk_index.replace_documents(chunks, new.select(*chunks.columns))
    assert [r["content"] for r in after.where("doc_id = 1").collect()] == ["short"]
    assert after.where(F.col("doc_id") != 1).count() == chunks.where(F.col("doc_id") != 1).count()
    assert chunk_index.remove_collection(chunks, "007").where("collection_id = '007'").count() == 0


def test_names(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 1.25)], "doc_id bigint, score double")
    names = spark.createDataFrame([(1, "a.txt"), (2, "")], "doc_id bigint, name string")
    got = search.with_names(hits, names).select(
        "doc_id", search.format_hit(F.lit(1), F.col("doc_name"), F.col("score")).alias("t")
    )
    assert {r["doc_id"]: r["t"] for r in got.collect()} == {
        1: "--- [1] a.txt (relevance: 0.50) ---", 2: "--- [1] doc#2 (relevance: 1.25) ---",
    }


def test_index_ranking_matches_scan(spark):
    rows = corpus(11, 200)
    chunks = chunk_rows(spark, rows)
    index = chunk_index.write_index(chunks.drop("tokens", "dl"), run_dir(spark, "index"))
    queries = [("x", "go the"), ("y", "data data slow"), ("z", "nothing here")]
    for k in (0, 4):
        got = chunk_index.search_index(spark, index, queries, k)
        for name, q in queries:
            assert as_scores(got.where(F.col("query_id") == name)) == naive_bm25(rows, q, k)
    texts = {(r[0], r[1], r[2]): r[3] for r in rows}
    for r in chunk_index.search_index(spark, index, queries, 4).collect():
        assert texts[r["collection_id"], r["doc_id"], r["position"]] == r["content"]
    assert chunk_index.ranked(spark, index, [("q", " ! ")], 3).count() == 0


def test_term_counts_by_runs_of_sorted_tokens(spark):
    from collections import Counter

    tokens = [["b", "a", "ab", "b", "a1", "a", "b"], [], ["x"] * 100_000 + ["xx"], ["9", "10", "9"]]
    chunks = spark.createDataFrame(
        [("c", i, 0, t, len(t)) for i, t in enumerate(tokens)], "collection_id string, doc_id bigint, position int, tokens array<string>, dl int")
    found = search.term_counts(chunks)
    got = {(r["doc_id"], r["term"]): r["tf"] for r in found.collect()}
    assert got == {(i, t): n for i, ts in enumerate(tokens) for t, n in Counter(ts).items()}
    # Functions over array items are interpreted, which took most of the time of postings.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scanning_chunks_writes_no_postings(spark, data, tmp_path):
    import os
    import shutil

    from quillgrid import plans
    from quillgrid.plans import search_plans

    shutil.copy(f"{data}/documents.parquet", tmp_path)
    assert plans.queries()["chunk_scan"](spark, str(tmp_path)).count() > 0
    key = (spark.sparkContext.applicationId, str(tmp_path))
    assert key not in search_plans._INDEXES
    stored = search_plans.stored_chunks(spark, str(tmp_path)).path.removeprefix("file:")
    assert sorted(os.listdir(stored)) == ["chunks"]
    assert search_plans.index(spark, str(tmp_path)).path.removeprefix("file:") == stored
    assert sorted(os.listdir(stored)) == ["chunks", "keys", "postings", "stats", "terms"]


def test_chunks_are_shuffled_without_their_tokens(spark, monkeypatch):
    written = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda self, *a, **k: written.append(self._df))
    docs = spark.createDataFrame([("c", 1, 0, "A b")], "collection_id string, doc_id bigint, position int, content string")
    chunk_index.write_chunks(search.with_tokens(docs), "unused")
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[: plan.index("RebalancePartitions")] and "regexp_extract_all" not in plan[plan.index("RebalancePartitions"):]
