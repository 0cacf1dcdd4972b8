"""Prefix trie, packed ids and periodic runs against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import packed_ids, periodic_runs, prefix_trie, textbytes

DOCS = "doc_id long, text string, start string, path string, bucket string"


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


# ---- prefix trie

def plain_paths(rows):
    """Rebuilt conversations as tuples of (role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, name, len(text), role, text))
    own = {c: [(r[4], r[5]) for r in sorted(t)] for c, t in own.items()}
    return {c: tuple(own.get(c - c % 100, [])[:crc(c) % 6] + t[crc(c) % 6:]) for c, t in own.items()}


def plain_trie(paths):
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in under),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 260), 700, 701, 1203]:
        copy = rng.random() < 0.4
        for t in range(rng.randint(1, 7)):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, "same é" * t if copy else f"w{rng.randint(0, 2)}"))
    rows += [(5, None, None, None), (6, 1, None, "x"), (6, 1, "user", "x"), (6, 1, "user", "x"), (None, 1, "user", "lost"), (400, None, None, None)]
    rows += [(500, t, "user", str(t)) for t in range(700)] + [(c, t, "user", str(t)) for c in (801, 802) for t in range(700)]
    return rows


def test_trie(spark, talks, monkeypatch):
    df = spark.createDataFrame([(*r, "x", "y") for r in talks], "conv_id long, turn long, role string, text string, path string, shard string").repartition(3)
    want = plain_trie_of_short(talks)
    short = df.where("conv_id < 500 OR conv_id IN (700, 701, 1203) OR conv_id IS NULL")
    got = prefix_trie.trie(prefix_trie.rebuilt_paths(short), shards=7)
    assert Counter(map(tuple, got.collect())) == want
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 2)
    assert Counter(map(tuple, prefix_trie.trie(prefix_trie.rebuilt_paths(short), shards=40, piece=2).collect())) == want
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(df.limit(0))).count() == 0


def plain_trie_of_short(talks):
    return plain_trie(plain_paths([r for r in talks if r[0] is None or r[0] < 500 or r[0] in (700, 701, 1203)]))


def test_trie_long_paths_and_copies(spark, talks):
    df = spark.createDataFrame([r for r in talks if r[0] and 500 <= r[0] <= 802], "conv_id long, turn long, role string, text string")
    rows = {(r.depth, r.conv_id): r for r in prefix_trie.trie(prefix_trie.paths(df), shards=5).collect()}
    deep = rows[700, 500]
    assert (deep.n_convs, deep.n_children, deep.n_leaves, deep.saved_tokens) == (3, 0, 1, 2 * len("699"))
    assert deep.ends_sha256 == hashlib.sha256(b"500,801,802").hexdigest()
    assert rows[0, 500].saved_tokens == sum(2 * len(str(t)) for t in range(700)) and rows[1, 500].parent_conv_id == 500
    copies = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    rows = sorted(prefix_trie.trie(prefix_trie.paths(copies), shards=9).collect(), key=lambda r: r.depth)
    assert [(r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in rows] == [(3000, 1, 1, 2999 * 5), (3000, 0, 1, 2999 * 5)]
    assert rows[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


def test_skeleton_is_bounded(monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 10)
    frame = prefix_trie.Skeleton([(bytes([i]) * 16 * (i + 1), i) for i in range(9)])
    assert len(frame.parent) <= 10 and frame.splitters == sorted(frame.splitters) and frame.splitters


# ---- packed ids

@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_pack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        words = packed_ids.pack(ids, bits)
        assert len(words) == -(-n * bits // 64)
        whole = "".join(format(int(i), f"0{bits}b")[::-1] for i in ids)
        assert all(int(w) == int(whole[64 * k:64 * k + 64][::-1], 2) for k, w in enumerate(words))
        assert np.array_equal(packed_ids.unpack(words, bits, 0, n), ids)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(packed_ids.unpack(words, bits, a, b), ids[a:b])
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([1 << bits]), bits)


def test_width():
    assert [packed_ids.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("bits", [13, 16])
def test_file(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(packed_ids, "BLOCK", 100)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (1, 250, 99, 100, 1, 730)]
    out = packed_ids.Writer(str(tmp_path / "a" / "x.ids"), bits)
    for k, d in enumerate(docs):
        out.add(np.array([k - 2]), np.array([len(d)]), d)
    assert out.close() == len(docs)
    for path in (str(tmp_path / "a" / "x.ids"), f"file://{tmp_path}/a/x.ids"):
        file = packed_ids.Reader(path)
        assert file.docs.tolist() == [-2, -1, 0, 1, 2, 3] and file.bits == bits and len(file.offsets) == -(-sum(map(len, docs)) // 100)
        assert all(np.array_equal(file.document(k), d) for k, d in enumerate(docs))
        every = np.concatenate(docs)
        assert np.array_equal(np.concatenate(list(file.blocks())), every)
        for a in range(0, len(every), 37):
            assert np.array_equal(file.ids(a, min(a + 150, len(every))), every[a:a + 150])
        file.close()
    (tmp_path / "y").write_bytes(b"z" * 200)
    with pytest.raises(ValueError):
        packed_ids.Reader(str(tmp_path / "y"))


def plain_ids(rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["alpha", "β", "12", "x\n\n", "don't", "　q"]) for _ in range(rng.randint(0, 90))) for i in range(-3, 60)}
    rows = sorted(texts.items()) + [(100, "z " * 30_000), (101, ""), (102, None)]
    df = spark.createDataFrame([(i, t, "s", "p", "b") for i, t in rows], DOCS).repartition(5)
    assert sorted(map(tuple, packed_ids.round_trip(df).collect())) == plain_ids(rows)
    monkeypatch.setattr(packed_ids, "FILE_IDS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    manifest = packed_ids.write(df, packed_ids.run_dir(spark, "some"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 4 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    assert sorted(map(tuple, packed_ids.read(manifest).collect())) == plain_ids(rows)
    again = [(None, "null id"), (1, "one"), (1, "one"), (1, "two"), (2, "three")]
    got = packed_ids.round_trip(spark.createDataFrame(again, "doc_id long, text string")).collect()
    assert Counter(r.n_tokens for r in got) == Counter(n for _, _, n, _ in plain_ids(again))
    assert [(r.doc_id, r.start) for r in got if r.start == 0] == [(None, 0)]
    assert max(r.start for r in got if r.doc_id == 1) < min(r.start for r in got if r.doc_id == 2)
    assert packed_ids.round_trip(df.limit(0)).count() == 0


# ---- periodic runs

def plain_runs(w, least=24, times=3):
    """All runs by reading every diagonal."""
    found = {}
    n = len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, q, n) for (s, n), q in found.items())


def plain_collapse(doc, text, edit):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), crc(doc)
    if edit and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts(rng, n):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            base = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 45))]
            if rng.random() < 0.3:
                base = base * rng.randint(2, 4) + base[:1]
            parts += (base * rng.randint(1, 7))[:rng.randint(1, 400)]
            parts += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        out.append(rng.choice(["  ", " ", "\t\n"]).join(parts))
    return out


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_texts():
    rng = random.Random(11)
    texts = [t.split() for t in periodic_texts(rng, 150)]
    texts += [fibonacci(600), ["a"] * 500, [], ["a"], ["a"] * 23, ["a"] * 24, list("ab") * 12, [str(i % 70) for i in range(229)], [str(i % 70) for i in range(209)]]
    texts += [["a"] * 60 + ["b"] + ["a"] * 60 + ["b"] + ["a"] * 60 + ["b"] + ["a"] * 60, [format(i, "b").count("1") % 2 and "p" or "q" for i in range(900)]]
    raw = [" ".join(t).encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, first = textbytes.words(buf, off)
    value = textbytes.span_hashes(textbytes.prefix_hashes(textbytes.BYTE_VALUES[buf]), start, end)
    text, at, length, period = periodic_runs.runs(value, first)
    got = {}
    for t, s, n, q in zip(text.tolist(), at.tolist(), length.tolist(), period.tolist()):
        got.setdefault(t, []).append((s, q, n))
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain_runs(t), t
    assert sum(map(len, got.values())) > 200


def test_runs_after_a_hash_error(monkeypatch):
    """Wrong prefix hashes change nothing."""
    w = np.array([i % 20 for i in range(90)] + [99] + [i % 20 for i in range(90)], np.uint64)
    first = np.array([0, len(w)])
    want = [x.tolist() for x in periodic_runs.runs(textbytes.mix(w), first)]
    monkeypatch.setattr(periodic_runs, "equal_length", lambda prefix, a, b, most, backward=False: most)
    assert [x.tolist() for x in periodic_runs.runs(textbytes.mix(w), first)] == want and len(want[0]) == 2


def test_collapse(spark):
    rng = random.Random(12)
    rows = list(enumerate(periodic_texts(rng, 120)))
    rows += [(i, " ".join(str(rng.randint(0, 400)) for _ in range(rng.randint(1, 300)))) for i in range(200, 300)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "a " * 40), (None, None), (303, "é　 x " * 30), (304, "same " * 50), (304, "same " * 50), (305, "y" * 30_000)]
    rows += [(306, "q r s " * 4000)]
    df = spark.createDataFrame([(i, t, "s", "p", "b") for i, t in rows], DOCS).repartition(4)
    for edit in (False, True):
        got = Counter(map(tuple, periodic_runs.collapse(df, sample_edit=edit).collect()))
        assert got == Counter(plain_collapse(i, t, edit) for i, t in rows if i != 306) + Counter(r for r in got if r[0] == 306)
    told = {r.doc_id: r for r in periodic_runs.collapse(df, with_text=True).where("doc_id IN (304, 306)").collect()}
    assert told[306].collapsed == "q r s" and told[304].collapsed == "same" and told[306].exponent_milli == 4_000_000
    assert periodic_runs.collapse(df.limit(0)).count() == 0


def test_a_very_long_repetitive_text():
    words = np.array([i % 3 for i in range(300_000)] + [i % 40_000 for i in range(200_000)], np.uint64)
    text, at, length, period = periodic_runs.runs(textbytes.mix(words), np.array([0, len(words)]))
    assert (at[0], period[0], length[0]) == (0, 3, 300_003) and (int(at[-1]), int(period[-1])) == (300_000, 40_000) and len(at) == 2


def test_queries_are_registered():
    from quillgrid.llm import queries

    assert {"op11_prefix_trie", "op12_packed_ids", "op13_periodic_runs"} <= set(queries.queries())
