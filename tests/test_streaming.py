import datetime as dt
import os


from quillgrid.operators import collections
from quillgrid.session import run_dir
from quillgrid.sources import chunk_index, files, sinks
from quillgrid.sources.search_store import SearchStore
from quillgrid.streaming import ingest, milestones, reindex
from tests import fixtures as fx


def test_ingest_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    docs = {"p.csv": fx.PEOPLE, "l.log": fx.LOG, "n.json": fx.NESTED, "t.txt": fx.TICKETS}
    for name, text in docs.items():
        (src / name).write_text(text)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ingest.ingest(spark, str(src), out, ck).awaitTermination()
    batch = ingest.analyse(files.documents_from_files(spark, str(src)))
    pick = lambda d: sorted(
        (r["filename"], r["doc_type"], r["row_count"], tuple(r["issues"]), r["clean"]["currency_values"])
        for r in d.collect()
    )
    assert pick(spark.read.parquet(out)) == pick(batch)
    assert {r[0]: r[1] for r in pick(batch)} == {
        "p.csv": "csv", "l.log": "log", "n.json": "json", "t.txt": "key_value",
    }
    # What arrives later is added; what was read is not read again.
    (src / "x.xml").write_text(fx.XML)
    ingest.ingest(spark, str(src), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_upload_limit_cuts_bytes(spark, tmp_path):
    (tmp_path / "big.txt").write_text("abcdef")
    got = files.documents_from_files(spark, str(tmp_path), limit=4).first()
    assert got["raw_content"] == "abcd" and got["filename"] == "big.txt"


def test_reindex(spark, tmp_path):
    schema = "doc_id bigint, raw_content string, structured_json string, changed_at timestamp_ntz"
    src = str(tmp_path / "changes")
    stamp = lambda i: dt.datetime(2024, 1, 1, 0, 0, i)
    docs = "collection_id string, doc_id bigint, text string"
    store = SearchStore.create(spark, run_dir(spark, "store"))
    store.put(spark.createDataFrame([("a", 1, ""), ("b", 1, "old"), ("a", 2, "old two"), ("c", 9, "kept")], docs))

    def send(rows, memberships=None):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        reindex.reindex(stream, store, str(tmp_path / "ck"), memberships).awaitTermination()
        return {(r["collection_id"], r["doc_id"], r["content"]) for r in store.snapshot().chunks().collect()}

    assert send([(1, "raw one", None, stamp(1)), (2, "raw two", "", stamp(1)), (77, "no collection", None, stamp(1))]) == {
        ("a", 1, "raw one"), ("b", 1, "raw one"), ("a", 2, "raw two"), ("c", 9, "kept"),
    }
    # The second document ends up empty: its chunks go, and nothing takes their place.
    want = {("a", 1, "{new}"), ("b", 1, "{new}"), ("c", 9, "kept")}
    assert send(
        [(1, "raw one", "{old}", stamp(2)), (1, "raw one", "{new}", stamp(3)), (2, "  ", None, stamp(4))]
    ) == want
    found = chunk_index.ranked(spark, store.snapshot(), [("q", "new raw old two kept")], 5).collect()
    assert sorted((r["collection_id"], r["doc_id"]) for r in found) == [("a", 1), ("b", 1), ("c", 9)]
    # Memberships may come from elsewhere.
    members = spark.createDataFrame([("d", 5)], "collection_id string, doc_id bigint")
    assert send([(5, "five", None, stamp(6))], lambda: members) == want | {("d", 5, "five")}
    assert len(store.snapshot().segments) == 4 and store.compact().chunks().count() == 4


def test_milestones_agree_with_batch(spark, tmp_path):
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    rows = [("s1", "upload", t(1)), ("s1", "upload", t(5)), ("s2", "save_summary", t(2)), ("s2", "noise", t(3))]
    src = str(tmp_path / "ev")
    events = spark.createDataFrame(rows, "s string, a string, ts timestamp_ntz")
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    milestones.run(milestones.milestone_events(stream, "s", "a", "ts"), out, ck).awaitTermination()
    kind = dict(events.dtypes)["s"]
    got = {(r["session"], r["milestone"]) for r in milestones.earned(spark, out, kind).collect()}
    batch = collections.milestones(events, "s", "a", "ts").where("milestone != 'power_user'")
    assert got == {(r["session"], r["milestone"]) for r in batch.collect()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1,2", "x|y"), ("", 'q"')], "b string, a string").coalesce(1)
    sinks.write_table(df, str(tmp_path / "c"), "csv")
    sinks.write_table(df, str(tmp_path / "m"), "markdown")
    sinks.write_table(df, str(tmp_path / "t"), "tsv")
    sinks.write_table(df, str(tmp_path / "j"), "json")
    read = lambda d: "".join(
        open(os.path.join(tmp_path, d, f)).read() for f in sorted(os.listdir(tmp_path / d)) if f.startswith("part")
    )
    assert read("c") == 'a,b\nx|y,"1,2"\n"q""",\n'
    assert read("m") == "| a | b |\n| --- | --- |\n| x\\|y | 1,2 |\n| q\" |  |\n"
    assert read("t").splitlines()[0] == "a\tb"
    back = files.csv_file(spark, str(tmp_path / "c")).collect()
    assert {(r["a"], r["b"]) for r in back} == {("x|y", "1,2"), ('q"', None)}
    assert files.json_file(spark, str(tmp_path / "j"), "a string, b string").count() == 2
    try:
        sinks.write_table(df, str(tmp_path / "z"), "pdf")
        raise AssertionError("an unknown format must be refused")
    except ValueError:
        pass


def test_milestone_once_over_far_batches(spark, tmp_path):
    """Three batches months apart, the last one late: one row with the earliest time."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "s bigint, a string, ts timestamp"
    for n, day in enumerate(("2024-02-01", "2024-06-01", "2024-01-01")):
        spark.sql(f"SELECT 1L AS s, 'upload' AS a, TIMESTAMP'{day}' AS ts UNION ALL SELECT 1L, 'other', TIMESTAMP'{day}'").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        milestones.run(milestones.milestone_events(stream, "s", "a", "ts"), out, ck).awaitTermination()
    rows = milestones.earned(spark, out).collect()
    assert [(r.session, r.milestone, str(r.earned_at.date())) for r in rows] == [(1, "first_upload", "2024-01-01")]


def test_the_fifth_document_earns_once(spark, tmp_path):
    """Five uploads over three batches; a late one moves the time to the fifth earliest, a sixth changes nothing."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    stamp = lambda i: dt.datetime(2024, 1, 1, 0, i)
    schema = "s bigint, a string, ts timestamp_ntz"
    seen, want = [], [None, None, 14, 12, 12]
    for batch, five in zip(([10, 11], [12, 12], [14, 15], [1], [40]), want):
        rows = [(1, "upload", stamp(i)) for i in batch] + [(2, "upload", stamp(i)) for i in batch[:1]] + [(1, "other", stamp(0))]
        seen += [i for i in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        milestones.run(milestones.milestone_events(stream, "s", "a", "ts", power_action="upload"), out, ck).awaitTermination()
        got = {(r.session, r.milestone): r.earned_at.minute for r in milestones.earned(spark, out).collect()}
        assert got.get((1, "power_user")) == five == (sorted(seen)[4] if len(seen) >= 5 else None)
        assert got[1, "first_upload"] == min(seen) and ((2, "power_user") in got) == (batch == [40])
    batch_form = collections.in_order(milestones.earned(spark, out)).where("session = 1").orderBy("place").collect()
    assert [(r.place, r.milestone) for r in batch_form] == [(1, "first_upload"), (2, "power_user")]


def test_batches_of_changes_are_written_by_many_tasks(spark, data, tmp_path):
    import glob

    from quillgrid.plans import stream_plans

    spark.read.parquet(f"{data}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bytes_kept = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        store = stream_plans._changed_store(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", bytes_kept)
    root = store.root.removeprefix("file:").removesuffix("/store")
    assert [len(glob.glob(f"{root}/changes/n={n}/*.parquet")) for n in (1, 2, 3)] == [3, 3, 3]
    assert store.snapshot().batch == 2
