"""The operators against plain restatements, over small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bpe, chat, decontaminate, fingerprints, hmm_lm, html_main, jaccard_join, packing, suffix_dedup, textbytes, token_counts, toxicity
from quillgrid.llm.components import components

SCHEMA = "doc_id long, text string, score string, n_shingles string, bucket string, node string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, passage = prose(rng, 90), prose(rng, 60)
    out = [(i, prose(rng, rng.randint(1, 150))) for i in range(40)]
    out += [(100 + i, base) for i in range(4)]
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, f"{prose(rng, 30)} {passage} {prose(rng, 9)}") for i in range(5)]
    out += [(400, None), (401, ""), (402, "  \n"), (403, "one two"), (404, "ONE two"), (405, "x" * 9000), (406, "a b " * 3000), (None, base), (None, None)]
    out += [(500, passage), (500, passage), (-5, prose(rng, 40) + "   x 　\n\n y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "n", "b", "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_fingerprints(docs, rows, none):
    got = fingerprints.edited_pairs(docs).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for a, b in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(a[2]) // 4
        want.append((a[1] if a[0] else None, len(a[2]), hashlib.sha256((a[2][:len(a[2]) - q] + b[2][:q]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    assert len({r.fingerprint for r in got if r.doc_id in range(100, 104)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got if r.n_chars > 200]) > 0.4
    assert fingerprints.edited_pairs(none).count() == 0
    assert "fingerprint" in fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit(1))).columns


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", "a\\l\\\\h<#:", "### user: x</turn>\n", None, "\\\\c \\", "é<</turn>"]
    turns = [(i % 3, t, "assistant" if t != "" and t % 2 else "us:er", x) for i in range(6) for t, x in enumerate(texts)]
    rows = spark.createDataFrame([(c, t, r, x) for c, t, r, x in turns] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    done = chat.format_chat(chat.as_records(rows), "record")
    read = done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()
    for r in read:
        own = sorted((t or 0, role or "", x or "") for c, t, role, x in turns + [(None, None, None, None)] if c == r.conv_id)
        assert [tuple(x) for x in r.t] == [(role, x) for _, role, x in own]
        assert r.m == "".join(x for _, role, x in own if role == "assistant")


def test_chat_layouts(spark):
    layouts = {
        '{"instruction":"a","input":"","output":"o"}': [("user", "a"), ("assistant", "o")],
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"3"}]}': [("user", "h"), ("assistant", "3")],
        '{"prompt":null,"response":"r"}': [("user", ""), ("assistant", "r")],
        '{"x":1}': None, "bad": None, None: None,
    }
    df = spark.createDataFrame([(k, "t") for k in layouts], "j string, turns string")
    for r in chat.with_turns(df, "j").collect():
        assert (r.turns and [tuple(t) for t in r.turns]) == layouts[r.j]
    assert chat.format_chat(df.limit(0), "j").count() == 0


def test_chat_long_texts(spark):
    long = F.repeat(F.lit('a "\\<#:\n{é} '), 2_000_000)
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.when(F.col("id") == 0, F.lit("short")).otherwise(long).alias("text"))
    done = chat.format_chat(chat.as_records(rows), "record")
    turns, masked = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    got = done.select("layout", F.size(turns).alias("n"), turns[0]["text"].alias("first"), (turns[1]["text"] == long).alias("same"), (masked == long).alias("mask")).collect()
    assert [tuple(r) for r in got] == [("messages", 2, "short", True, True)]


def test_chat_long_records_as_short_ones(spark, monkeypatch):
    texts = [
        '{"messages": [{"role" : "human", "content":"a \\"b\\" \\\\"}, {"content":null,"role":"gpt"}, {"role":"us:er","content":"{\\n: [\\u00e9"}]}',
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"3"}]}', '{"instruction":"a","input":"","output":"o\\\\"}',
        '{"system":"s","instruction":"a","input":"b","output":"o"}', '{"pr\\u006fmpt":null,"response":"r"}', '{"prompt\\"":"x","response":"r"}',
        '{"x":"1"}', '{"prompt":"x","response":"r\n"}', '{"prompt":"x", "response"', "bad", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")

    def found():
        return sorted(map(str, chat.with_turns(df, "j").select("i", "layout", "schema_id", "turns").collect()))

    want = found()
    monkeypatch.setattr(chat, "LONG_BYTES", -1)
    got = [x.replace("layout='prompt_response'", "layout=None") if "i=7" in x else x for x in found()]
    monkeypatch.undo()
    assert [x.split("turns=")[1] for x in got] == [x.split("turns=")[1] for x in want]
    assert [x.split("schema_id=")[0] for x in got] == [x.split("schema_id=")[0] for x in want]


def test_html(spark):
    pages = {
        '<nav><ul><li><a href="/x">x</a></li></ul></nav><article><h1>A &amp; B</h1><p>one\n  two<br><p><b>three</article><footer>&copy; z</footer>': "A & B\none two\nthree",
        '<body><header>h</header><main><p>kept text here.</p><aside><p>other side</p></aside><p>more</p></main><div class="comments"><p>a reader says</p></div>': "kept text here.\nmore",
        '<article><script>var t="</p>";</script><p>x < y &lt; z</p><style>p{}</style></article>': "x < y < z",
        None: "", "": "", '<div class="ad">buy</div>': "",
    }
    df = spark.createDataFrame([(i, h, "t") for i, h in enumerate(pages)], "page_id long, html string, text string")
    for r in html_main.extract(df).collect():
        assert (r.text, r.n_chars) == (list(pages.values())[r.page_id], len(list(pages.values())[r.page_id]))
    field = html_main.train(html_main.labelled_pages(120))
    held = html_main.labelled_pages(60, seed=77)
    wrong = sum(p != q for b, y in held for p, q in zip(field.decode(b), y))
    assert wrong < 0.02 * sum(len(y) for _, y in held)


def jaccard_classes(rows):
    """Sizes by row, and the smallest id reachable, by comparing all pairs."""
    low = -(1 << 63)
    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((low if i is None else i, frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, p) in enumerate(sets):
        for b, (_, q) in enumerate(sets[:a]):
            if p and q and 100 * len(p & q) >= 80 * len(p | q):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def test_jaccard(docs, rows, none, monkeypatch):
    def plain(x):
        return None if x == -(1 << 63) else x

    want = Counter((plain(a), n, plain(c)) for a, n, c in jaccard_classes(rows))
    assert Counter(map(tuple, jaccard_join.similar(docs).collect())) == want
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    assert Counter(map(tuple, jaccard_join.similar(docs).collect())) == want
    assert jaccard_join.similar(none).count() == 0


def test_count_tree():
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (300, 64))
    counts[150:] = counts[:150] + (rng.random((150, 64)) < 0.05)
    size, label = counts.sum(1), np.arange(300) // 2
    got = {(min(a, b), max(a, b)) for x, y in jaccard_join.CountTree(counts, size, label).pairs() for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for b in range(300) for a in range(b) if label[a] != label[b] and np.minimum(counts[a], counts[b]).sum() >= jaccard_join.needed(size[a], size[b])}
    assert got == want and len(want) > 100


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90}


def test_packing(docs, rows, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cut = [0, *range(len(ids) - (len(ids) - 1) // 64 * 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack(docs, capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 64)
    assert packing.pack(none).count() == 0


def check_sequences(items, capacity):
    by = {}
    for s, o, n in items:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    sizes = Counter(rng.choice((rng.randint(1, 100), rng.randint(20, 60), 33)) for _ in range(rng.randint(1, 400)))
    plan = packing.make_plan(dict(sizes), 100)
    assert plan.used == dict(sizes)
    items = [(f + q // per, o + q % per * w, w) for w, _, n, f, per, o in plan.segments for q in range(n)]
    used = check_sequences(items, 100)
    bins = []
    for w in sorted(sizes.elements(), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= w]
        i = min(fits, key=lambda i: bins[i], default=None)
        if i is None:
            bins.append(100 - w)
        else:
            bins[i] -= w
    assert -(-sum(w * n for w, n in sizes.items()) // 100) <= used <= len(bins)


def test_toxicity(spark, none):
    rng = random.Random(9)
    docs = [(i, (prose(rng, 60) + (" vilest wretch " if i % 7 == 0 else " ") + prose(rng, 20))) for i in range(420)] + [(900, None), (901, ""), (None, "x")]
    labels = [(i, int(i % 7 == 0)) for i in range(420)] + [(900, None), (None, 1), (0, 1)]
    frame = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, score string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.is_held_out())
    got = toxicity.score(frame, model).withColumn("held", toxicity.is_held_out()).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 420]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in held]) > 0.97
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int")).bias < 0


def test_toxicity_keeps_the_prior_of_all_rows(spark):
    frame = spark.createDataFrame([(i, "") for i in range(420)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(420)] + [(1000 + i, 1) for i in range(50)], "doc_id long, toxic int")
    for most in (20, 100, 3000):
        assert toxicity.fit(frame, labels, max_rows=most).bias == pytest.approx(math.log(60 / 360))


def test_toxicity_passes_over_long_texts(spark):
    rng = random.Random(10)
    ids = [r.id for r in spark.range(80).orderBy(F.xxhash64("id")).collect()]
    toxic = [i for i in ids if i % 2]
    texts = {i: prose(rng, 10) + (" vilest wretch" if i % 2 else "") for i in ids}
    texts[toxic[0]] = "long " * 2000
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")

    def predicted(max_chars):
        frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
        return {r.doc_id: r.predicted for r in toxicity.score(frame, toxicity.fit(frame, labels, max_chars=max_chars)).collect()}

    got = predicted(9000)
    assert all(got[i] == i % 2 for i in ids if i != toxic[0])
    # No text fits: the shortest of each label is learned from, and neither label wins by default.
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert toxicity.fit(frame, labels, max_chars=3).bias == pytest.approx(0)


def test_toxicity_gathers_only_the_slots_that_count(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, 300) + (" vilest wretch" if i % 5 == 0 else "") for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    gathered, plain = [], type(frame).toArrow

    def to_arrow(self):
        gathered.append((out := plain(self)).nbytes)
        return out

    monkeypatch.setattr(type(frame), "toArrow", to_arrow)
    model = toxicity.fit(frame, labels)
    sets = [s for t in texts for s in toxicity.distinct_slots(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]
    counts = np.zeros((2, toxicity.SLOTS))
    for i, s in enumerate(sets):
        counts[int(i % 5 == 0), s] += 1
    # Whole sets were gathered before, some 12 bytes for each character of the sample.
    assert sum(gathered) < sum(map(len, texts)) < sum(s.nbytes for s in sets)
    ratio = toxicity.ratios(counts[1], counts[0], 40, 160)
    used = np.flatnonzero(ratio)
    numbers = [np.searchsorted(used, s[ratio[s] != 0]) for s in sets]
    want = toxicity.train(numbers, np.arange(200) % 5 == 0, used, ratio[used])
    assert len(want.slots) and model.slots.tolist() == want.slots.tolist()
    assert model.weights == pytest.approx(want.weights) and model.bias == pytest.approx(want.bias)


def test_toxicity_sends_few_rows_to_choose_a_sample(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("_order")).repartition(3).cache()
    want = [r.doc_id for r in rows.orderBy("_order", "doc_id").collect()]
    sorted_rows, plain = [], type(rows).orderBy

    def order_by(self, *columns):
        sorted_rows.append(self.count())
        return plain(self, *columns)

    monkeypatch.setattr(type(rows), "orderBy", order_by)
    # The last number is far from the count: too few rows lie under the bound, and all are taken.
    for n, most in ((4000, 100), (4000, 1999), (4000, 4000), (4000, 9000), (0, 5), (10 ** 7, 300)):
        assert [r.doc_id for r in toxicity.first_rows(rows, n, most)] == want[:most]
    assert sorted_rows[0] < 300 and sorted_rows[-1] == 4000
    sorted_rows.clear()
    frame = rows.select("doc_id", F.lit("some words").alias("text"))
    toxicity.fit(frame, rows.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), max_rows=50)
    assert sorted_rows and max(sorted_rows) < 200
    rows.unpersist()


def test_decontamination(spark, none):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(8, None), (9, ""), (10, "same words twice same words twice again and again")]
    edited = items[2][1].split()
    for k in range(3, 28, 9):
        edited[k] = "other"
    docs = [(i, prose(rng, 200)) for i in range(60)] + [(100, f"{prose(rng, 50)} {items[0][1]} {prose(rng, 50)}"), (101, " ".join(edited)), (102, items[0][1].upper().lower()),
                                                         (103, None), (104, ""), (None, items[1][1])]
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20, 10_000):
        got = decontaminate.contaminated(frame, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(100, 0), (101, 2), (102, 0), (None, 1)}
        assert all(0.5 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {*range(60), 103, 104}
    assert decontaminate.contaminated(none, bench).count() == 0 == decontaminate.contaminated(frame, bench.limit(0)).count()


def test_decontamination_finds_every_alignment(spark):
    rng = random.Random(12)
    common = "of the in a to and is it on by".split()

    def text(n):
        return [rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(n)]

    def edited(w, places):
        return [f"new{rng.randrange(9999)}" if i in places else x for i, x in enumerate(w)]

    items = [text(15), text(15), text(12), text(40), text(3), text(5), text(1), text(2), text(4)]
    docs = [text(60) for _ in range(40)]
    # Copies in more than 20 documents, of which one or no three words in a row stay.
    docs += [text(20) + edited(items[0], (3, 7, 11)) + text(20) for _ in range(30)] + [text(20) + edited(items[1], (2, 5, 9, 12)) + text(9) for _ in range(30)]
    docs += [edited(items[1], (2, 5, 8, 11, 14)), [x for w in items[2] for x in (w, f"put{rng.randrange(99)}")], edited(items[0], (0, 3, 6, 9, 12))]
    for w in items:
        for _ in range(25):
            docs.append(text(5) + [y for x in w for y in rng.choice(([x], [x], [x], [x, "put"], ["new"], []))] + text(5))
    hashed = [[decontaminate.clean_words(*textbytes.column_bytes(pa.array([" ".join(w)])))[0] for w in x] for x in (items, docs)]
    want = {}
    for d, words_d in enumerate(hashed[1]):
        for i, words_i in enumerate(hashed[0]):
            score = decontaminate.align(words_i, words_d)[0]
            if score >= len(words_i):
                want[d, i] = score / (2 * len(words_i))
    assert {(d, 0) for d in range(40, 70)} | {(d, 1) for d in range(70, 101)} | {(101, 2), (102, 0)} <= set(want)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == want


def test_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 5, 6, 9])) == (12, 1, 7)
    assert decontaminate.align(a, np.array([1, 2, 7, 3, 4, 5, 6])) == (11, 0, 7)
    assert decontaminate.align(a, np.array([8, 9])) [0] == 0


def test_token_counts(docs, rows, none, spark):
    rng = random.Random(8)

    def edits():
        return [(rng.randint(-3, 300), rng.randint(0, 300), rng.choice(("", " new words", "x", "\n\n", None, " 　"))) for _ in range(rng.randint(0, 5))]

    plan = [(i, t, edits()) for i, t in rows] + [(1, "a b", None), (2, "a b", [(None, None, None)])]
    frame = spark.createDataFrame(plan, "doc_id long, text string, edits array<struct<start:long,stop:long,put:string>>")
    want = Counter()
    for i, t, todo in plan:
        x = before = t or ""
        for start, stop, put in todo or ():
            s = min(max(0, start or 0), len(x))
            e = min(max(s, (start or 0) if stop is None else stop), len(x))
            x = x[:s] + (put or "") + x[e:]
        want[i, len(before), len(bpe.encode_whole(before)), len(x), len(bpe.encode_whole(x)), hashlib.sha256(x.encode()).hexdigest()] += 1
    got = token_counts.counts(frame).collect()
    assert Counter((r.doc_id, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens, r.edited_sha256) for r in got) == want
    assert token_counts.counts(frame.limit(0)).count() == 0


def test_suffix_dedup(docs, rows, none):
    low = -(1 << 63)
    ordered = sorted(((low if i is None else i, (t or "").encode()) for i, t in rows))
    seen, want = {}, Counter()
    for i, b in ordered:
        for k in range(len(b) - 49):
            seen[b[k:k + 50]] = min(i, seen.get(b[k:k + 50], i))
    for i, b in ordered:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[None if i == low else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.dedup(docs).collect())) == want
    assert suffix_dedup.dedup(none).count() == 0


def test_hmm(docs, rows, none):
    got = hmm_lm.score(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)), rounds=1).collect()
    known = Counter()
    for i, t in rows:
        if i is not None and math.fmod(i, 3):
            known.update([*words(t), None])
    n, v = sum(known.values()), len(known)
    want = Counter()
    for i, t in rows:
        c = [known[w] for w in [*words(t), None]]
        want[i, len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm_lm.score(none, F.lit(True)).count() == 0


def test_hmm_recursions():
    """Likelihood and expected counts against sums over all state paths."""
    import itertools

    rng = np.random.default_rng(2)
    emit = rng.random((2, hmm_lm.CLASSES))
    m = hmm_lm.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), emit / emit.sum(1, keepdims=True), np.ones(hmm_lm.CLASSES), None)
    kind = np.array([3, 9, 3, 1, 0, 7], np.uint16)
    first = np.array([0, 5, 6])
    total, moves, starts = [], np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(first, first[1:]):
        paths = {}
        for p in itertools.product((0, 1), repeat=int(b - a)):
            w = m.start[p[0]] * np.prod([m.emit[s, k] for s, k in zip(p, kind[a:b])]) * np.prod([m.move[x, y] for x, y in zip(p, p[1:])])
            paths[p] = w
        z = sum(paths.values())
        total.append(math.log(z))
        for p, w in paths.items():
            starts[p[0]] += w / z
            for x, y in zip(p, p[1:]):
                moves[x, y] += w / z
    assert np.allclose(m.likelihoods(kind, first), total)
    c = hmm_lm.expected_counts(m, kind, first)
    assert np.allclose(c[:2], starts) and np.allclose(c[2:6].reshape(2, 2), moves) and math.isclose(c[-1], sum(total))
    assert math.isclose(c[6:-1].sum(), 6)


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_small_points_keep_alike_sets():
    rng = np.random.default_rng(4)
    sets = []
    for n in (5, 60, 900, 1023, 1100, 4000, 40000):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: n - n // 10], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))]
        sets.append(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)))
    sizes = np.array([len(s) for s in sets])
    points = [jaccard_join.coarse_point(jaccard_join.point(s), len(s)) for s in sets]
    x, y = (a.ravel() for a in np.triu_indices(len(sets), 1))
    keep = jaccard_join.finer(points, sizes, x, y, cells=4096)
    for a, b, kept in zip(x.tolist(), y.tolist(), keep.tolist()):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert kept or both < jaccard_join.needed(sizes[a], sizes[b])
        if sizes[a] > 1500 and sizes[b] > 1500 and not both:
            assert not kept
    assert jaccard_join.finer([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).size == 0


def test_encoding_holds_little():
    rng = random.Random(12)
    some = [prose(rng, 1) for _ in range(20_000)]
    texts = [" ".join(rng.choices(some, k=1500)) for _ in range(500)] + [" ".join(rng.choices(some, k=500_000))]
    column, got = pa.array(texts), []
    tracemalloc.start()
    try:
        for _, _, buf, off in textbytes.slices(column, bpe.SLICE_BYTES):
            ids, first = bpe.encode(buf, off)
            got += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(got) == len(texts)
    for i in (0, 1, 250, 499, 500):
        assert got[i] == zlib.crc32(bpe.encode_whole(texts[i]).tobytes())
    assert peak < 110e6
