"""Suffix-array dedup by prefix-free parsing: bytes of 50-byte strings that an earlier document holds too.

Rolling hashes of 16 bytes part a text into phrases: a window of 50 bytes belongs to its smallest 16-byte hash (the leftmost of equals), the
trigger, and the windows of one trigger form a phrase. The choice depends on the window alone, so equal windows have equal triggers whatever
stands around them, and every window lies in just one phrase. Phrases are the dictionary; equal phrases of a document bucket are kept once with
their smallest document. Where a trigger occurs in more than one document, the dictionary's phrases meet in the trigger's bucket,
and their windows are put into one order (that of their hashes, which serves equality as the suffix order does), in which each group of equal
windows finds its smallest document. The parse then carries the answer back: a document repeats what its phrases repeat.

Triggers and phrases travel packed, once per document bucket; texts cross the network twice, dealt by ranges of ``doc_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import give_back, lean, materialise, parts_of, range_bucket

LENGTH = 50
TRIGGER = 16
_PLACE = np.uint64(30)
_NULL_ID = np.iinfo(np.int64).min
#: Bytes parsed at once: the passes stay in the processor's cache.
_SLICE = 1 << 17
#: Phrases of a task that are put together before they are dealt.
_HELD = 1_000_000


class Phrases:
    """The phrases of a column of texts: their text, first and last window, trigger hash and content hash."""

    def __init__(self, column: pa.Array, length: int = LENGTH):
        self.buf, self.off = T.column_bytes(column)
        parts = []
        for lo, _, buf, off in T.slices(column, _SLICE):
            doc, a, b, key, content = _parse(buf, off, length)
            parts.append((doc + lo, a + self.off[lo], b + self.off[lo], key, content))
        empty = np.zeros(0, np.int64)
        none = (empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
        self.doc, self.first, self.last, self.key, self.content = (np.concatenate(x) for x in zip(none, *parts))


def _parse(buf: np.ndarray, off: np.ndarray, length: int):
    n = len(buf) - length + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    prefix = T.prefix_hashes(T.BYTE_VALUES[buf])
    h = T.window_hashes(prefix, TRIGGER)
    ranked = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
    width, low = 1, ranked
    span = length - TRIGGER + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    place = (low & np.uint64((1 << 30) - 1)).astype(np.int64)[:n]
    whole = np.ones(n, bool)
    for begin, end in zip(off[:-1].tolist(), off[1:].tolist()):
        whole[max(begin, end - length + 1):end] = False
    new = whole.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    final = whole.copy()
    final[:-1] &= (place[1:] != place[:-1]) | ~whole[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(final)
    # Smallest hashes are small; mixed once more they fall into all buckets alike.
    return np.searchsorted(off, first, "right") - 1, first, last, T.mix(h[place[first]] + np.uint64(length)), T.span_hashes(prefix, first, last + length)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_NULL_ID)).astype(np.int64) if column.null_count else np.asarray(column).astype(np.int64)


def _deal(keys: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes to buckets 0 to n - 1, in order: where each bucket begins."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))


def _smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, the smallest and largest id of each, and for each item its key's number."""
    order = np.argsort(keys)
    k = keys[order]
    if not len(k):
        return k, order, ids[:0], ids[:0], order
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.flatnonzero(new)
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    i = ids[order]
    return k[head], order[head], np.minimum.reduceat(i, head), np.maximum.reduceat(i, head), back


def trigger_rows(docs: DataFrame, n: int, length: int) -> DataFrame:
    """``kb, bucket, keys, docs, many``: the distinct triggers of a task's documents by key bucket and document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            p = Phrases(batch.column(2), length)
            held.append((p.key, _ids(batch.column(1))[p.doc], np.asarray(batch.column(0)).astype(np.int64)[p.doc]))
            if sum(len(h[0]) for h in held) > _HELD:
                yield from deal(held)
                held = []
        yield from deal(held)

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, ids, bucket = (np.concatenate(x) for x in zip(*held))
        rows: list[tuple] = []
        for b in np.unique(bucket):
            pick = bucket == b
            keys, _, least, most, _ = _smallest(key[pick], ids[pick])
            cut = _deal(keys, n)
            rows += [(k, b, keys[s:e].tobytes(), least[s:e].tobytes(), (least[s:e] != most[s:e]).tobytes())
                     for k, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                ["kb", "bucket", "keys", "docs", "many"])

    return docs.select("bucket", "doc_id", "text").mapInArrow(lean(run), "kb int, bucket int, keys binary, docs binary, many binary")


def shared_triggers(rows: DataFrame, n: int) -> DataFrame:
    """``bucket, keys``: for each document bucket its triggers that more than one document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, docs, many = [], [], [], []
        for batch in batches:
            bucket += batch.column(1).to_pylist()
            keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            docs += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            many += [np.frombuffer(x.as_buffer(), bool) for x in batch.column(4)]
        if not keys:
            return
        every, ids = np.concatenate(keys), np.concatenate(docs)
        u, _, least, most, at = _smallest(every, ids)
        several = np.zeros(len(u), bool)
        several[at[np.concatenate(many)]] = True
        shared = ((least != most) | several)[at]
        stop = np.cumsum([len(k) for k in keys])
        out = [(b, k[shared[e - len(k):e]].tobytes()) for b, k, e in zip(bucket, keys, stop)]
        out = [(b, k) for b, k in out if k]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["bucket", "keys"])

    return rows.repartition(n, "kb").mapInArrow(lean(run), "bucket int, keys binary")


def _column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return table[name].combine_chunks() if table.num_rows else pa.array([], kind)


def phrase_rows(docs: DataFrame, shared: DataFrame, n: int, length: int) -> DataFrame:
    """``pb, bucket, sizes, docs, phrases``: the dictionary's phrases of shared triggers, each once per document bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        rows: list[tuple] = []
        p = Phrases(_column(left, "text", pa.string()), length)
        keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in right["keys"])]))
        if len(keys) and len(p.key):
            at = np.minimum(np.searchsorted(keys, p.key), len(keys) - 1)
            pick = np.flatnonzero(keys[at] == p.key)
            ids = _ids(_column(left, "doc_id", pa.int64()))[p.doc[pick]]
            _, one, least, _, _ = _smallest(p.content[pick], ids)
            order = np.argsort(p.key[pick[one]], kind="stable")
            one, least = pick[one[order]], least[order]
            size = p.last[one] - p.first[one] + length
            cut = _deal(p.key[one], n)
            codec = pa.Codec("zstd")
            for k, (s, e) in enumerate(zip(cut[:-1], cut[1:])):
                if e > s:
                    total = size[s:e].sum()
                    place = np.repeat(p.first[one[s:e]] - (np.cumsum(size[s:e]) - size[s:e]), size[s:e]) + np.arange(total)
                    rows.append((k, int(left["bucket"][0].as_py()), size[s:e].astype(np.uint8).tobytes(), least[s:e].tobytes(),
                                 codec.compress(p.buf[place].tobytes(), asbytes=True)))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table({"pb": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "sizes": pa.array(cols[2], pa.binary()),
                         "docs": pa.array(cols[3], pa.binary()), "phrases": pa.array(cols[4], pa.binary())})

    return docs.select("bucket", "doc_id", "text").groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        run, "pb int, bucket int, sizes binary, docs binary, phrases binary")


def _phrase_windows(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The content hash of each phrase, and the hashes of all its windows in turn; phrases are hashed a slice at a time."""
    names, hashes = [], []
    stop = np.cumsum(size)
    lo = 0
    while lo < len(size):
        begin = int(stop[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(stop, begin + T.SLICE_BYTES, "right")))
        n = size[lo:hi]
        start = np.cumsum(n) - n
        prefix = T.prefix_hashes(T.BYTE_VALUES[text[begin:int(stop[hi - 1])]])
        windows = n - length + 1
        at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        names.append(T.span_hashes(prefix, start, start + n))
        hashes.append(T.window_hashes(prefix, length)[at])
        lo = hi
    return np.concatenate(names), np.concatenate(hashes)


def repeated_windows(rows: DataFrame, n: int, length: int) -> DataFrame:
    """``bucket, phrases, begins, ends``: runs of a phrase's windows that a document before the phrase's own smallest one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                by.setdefault(r[0], []).append(r[1:])
        codec = pa.Codec("zstd")
        found: dict[int, list[tuple]] = {}
        for group in by.values():
            sizes = [np.frombuffer(r[1], np.uint8).astype(np.int64) for r in group]
            text = np.frombuffer(b"".join(codec.decompress(r[3], int(s.sum()), asbytes=True) for r, s in zip(group, sizes)), np.uint8)
            size = np.concatenate(sizes)
            ids = np.concatenate([np.frombuffer(r[2], np.int64) for r in group])
            name, h = _phrase_windows(text, size, length)
            windows = size - length + 1
            base = np.cumsum(windows) - windows
            phrase = np.repeat(np.arange(len(size), dtype=np.int32), windows)
            own = ids[phrase]
            _, _, least, _, back = _smallest(h, own)
            repeated = least[back] < own
            edge = np.ones(len(h) + 1, bool)
            edge[1:-1] = (repeated[1:] != repeated[:-1]) | (phrase[1:] != phrase[:-1])
            bounds = np.flatnonzero(edge)
            a, b = bounds[:-1], bounds[1:]
            keep = repeated[a]
            a, b = a[keep], b[keep]
            which = phrase[a]
            begin, end = (a - base[which]).astype(np.uint8), (b - 1 - base[which]).astype(np.uint8)
            source = np.repeat(np.arange(len(group)), [len(s) for s in sizes])[which]
            cut = np.searchsorted(source, np.arange(len(group) + 1))
            for r, s, e in zip(group, cut[:-1], cut[1:]):
                if e > s:
                    found.setdefault(r[0], []).append((name[which[s:e]].tobytes(), begin[s:e].tobytes(), end[s:e].tobytes()))
        for bucket, parts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), *(pa.array([b"".join(x)], pa.binary()) for x in zip(*parts))], ["bucket", "phrases", "begins", "ends"])

    return rows.repartition(n, "pb").mapInArrow(lean(run), "bucket int, phrases binary, begins binary, ends binary")


def _removed(left: pa.Table, right: pa.Table, length: int) -> tuple[Phrases, np.ndarray]:
    """The phrases of a document bucket and, for each byte, whether it goes."""
    p = Phrases(_column(left, "text", pa.string()), length)
    ids = _ids(_column(left, "doc_id", pa.int64()))[p.doc]
    change = np.zeros(len(p.buf) + 1, np.int32)
    u, _, least, _, back = _smallest(p.content, ids)
    later = least[back] < ids
    np.add.at(change, p.first[later], 1)
    np.add.at(change, p.last[later] + length, -1)
    if right.num_rows:
        name = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in right["phrases"]])
        begin, end = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in right[c]]).astype(np.int64) for c in ("begins", "ends"))
        order = np.argsort(name, kind="stable")
        name, begin, end = name[order], begin[order], end[order]
        lo, hi = (np.searchsorted(name, u, side)[back] for side in ("left", "right"))
        n = hi - lo
        run = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(p.first, n)
        np.add.at(change, where + begin[run], 1)
        np.add.at(change, where + end[run] + length, -1)
    return p, np.cumsum(change, dtype=np.int32, out=change)[:-1] > 0


def dedup(docs: DataFrame, length: int = LENGTH, with_kept: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``doc_id, text``. With ``with_kept`` also ``kept``, the
    bytes left, and ``kept_text``, their whole characters; and the columns to carry.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Matches never cross documents. A
    null text counts as empty, a null id as smaller than all; rows of the same id don't take from each other. Other columns are ignored,
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = parts_of(spark)
    bucket = range_bucket(docs, "doc_id", 2 * n).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bucket.alias("bucket"))
    shared = materialise(shared_triggers(trigger_rows(rows, 2 * n, length), n), "triggers")
    repeats = materialise(repeated_windows(phrase_rows(rows, shared, 2 * n, length), n, length), "repeats")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        p, gone = _removed(left, right, length)
        out = []
        for a, b in zip(p.off[:-1].tolist(), p.off[1:].tolist()):
            g = gone[a:b]
            kept = p.buf[a:b][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((b - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out)) or [[]] * 5
        table = {"doc_id": _column(left, "doc_id", pa.int64()), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                 "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        if with_kept:
            table |= {"kept": pa.array(cols[4], pa.binary()), "kept_text": pa.array([k.decode("utf-8", "ignore") for k in cols[4]], pa.string())}
        return pa.table(table | {f"_c{i}": left[f"_c{i}"] for i in range(len(carry))})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, kept_text string" if with_kept else "")
    schema += "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bucket.alias("bucket"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    done = whole.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(run, schema)
    return done.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})
