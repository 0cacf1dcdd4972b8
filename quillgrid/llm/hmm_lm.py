"""Language-model scores: a hidden Markov model over words, beside an add-one unigram base.

A state emits a word class (a hash of the word's last bytes), and the class gives the word with its smoothed share in the corpus; so
the model's own parameters stay of fixed size while the word counts grow with the corpus. Expected counts of Baum-Welch are summed
over all training text, partition by partition, in every round. Training reads the text in segments of up to 128 tokens, each begun
from the states' overall shares; scoring runs the scaled forward recursion over whole texts and so gives the exact likelihood.

Word counts and the words asked for travel packed: each task sends one sorted array per pair of word bucket and document bucket, so
that a frequent word crosses the network once per task and not once per use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import materialise, parts_of, range_bucket

CLASSES = 2048
STATES = 6
SEGMENT = 128
#: The hash and the class of the token that ends every text.
END_HASH = np.uint64(0x5DEECE66D1234567)
END_CLASS = 0
#: Tokens of a task that are put together before they are dealt.
_HELD = 3_000_000


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, the end tokens included, and each text's first token."""
    start, end, first = T.words(buf, off)
    low = T.LOWER[buf]
    h = T.span_hashes(T.prefix_hashes(T.BYTE_VALUES[low]), start, end)
    code = np.zeros(len(start), np.uint32)
    for back in (1, 2, 3):
        at = end - back
        inside = at >= start
        code = code * np.uint32(257) + np.where(inside, low[np.where(inside, at, 0)] + np.uint32(1), np.uint32(0)).astype(np.uint32)
    kind = (T.mix(code.astype(np.uint64)) % np.uint64(CLASSES - 1) + np.uint64(1)).astype(np.uint16)
    n = len(off) - 1
    h, kind = np.insert(h, first[1:], END_HASH), np.insert(kind, first[1:], END_CLASS)
    return h, kind, first + np.arange(n + 1)


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a text column, whose hashing goes slice by slice."""
    parts = [tokens(buf, off) for _, _, buf, off in T.slices(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(1, np.int64)
    size = np.concatenate([np.diff(f) for _, _, f in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(size)])


def asked_words(docs: DataFrame, n_words: int) -> DataFrame:
    """``wb, bucket, words, classes, counts``: for each task, document bucket and word bucket the sorted distinct words, with
    their counts in training texts. ``docs`` has ``bucket, learn, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            h, kind, first = batch_tokens(batch.column(2))
            owner = T.owners(first)
            held.append((h, kind, np.asarray(batch.column(0)).astype(np.int32)[owner], np.asarray(batch.column(1)).astype(np.float32)[owner]))
            if sum(len(x[0]) for x in held) > _HELD:
                yield from deal(held)
                held = []
        yield from deal(held)

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, kind, bucket, learn = (np.concatenate(x) for x in zip(*held))
        rows: list[tuple] = []
        for b in np.unique(bucket):
            pick = np.flatnonzero(bucket == b)
            u, at, back = np.unique(h[pick], return_index=True, return_inverse=True)
            count = np.bincount(back, learn[pick], len(u)).astype(np.uint32)
            c = kind[pick][at]
            wb = ((u >> np.uint64(32)) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(wb, np.arange(n_words + 1))
            rows += [(w, b, u[s:e].tobytes(), c[s:e].tobytes(), count[s:e].tobytes())
                     for w, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                ["wb", "bucket", "words", "classes", "counts"])

    return docs.select("bucket", "learn", "text").mapInArrow(run, "wb int, bucket int, words binary, classes binary, counts binary")


def answered_words(asked: DataFrame, n_words: int) -> DataFrame:
    """The asked words with their counts in the whole corpus (``bucket, words, counts``), and for each word bucket one row (bucket
    -1) with tokens and distinct words by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, words, classes, counts = [], [], [], []
        for batch in batches:
            bucket += batch.column(1).to_pylist()
            words += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            classes += [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(3)]
            counts += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(4)]
        if not words:
            return
        every = np.concatenate(words)
        u, at, back = np.unique(every, return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)
        kind = np.concatenate(classes)[at]
        stats = np.stack([np.bincount(kind, total, CLASSES), np.bincount(kind, total > 0, CLASSES)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([stats.tobytes()], pa.binary())], ["bucket", "words", "counts"])
        stop = np.cumsum([len(w) for w in words])
        for b, w, e in zip(bucket, words, stop):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([total[back[e - len(w):e]].tobytes()], pa.binary())],
                ["bucket", "words", "counts"])

    return asked.repartition(n_words, "wb").mapInArrow(run, "bucket int, words binary, counts binary")


@dataclass
class Model:
    """Chain and class emissions (fixed size), and what the classes count in the training texts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    tokens: np.ndarray
    types: np.ndarray

    def likelihoods(self, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each class sequence: the forward recursion, scaled every few steps."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        emit = np.ascontiguousarray(self.emit.T)
        total = np.zeros(len(order))
        a = None
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            e = emit[kind[begin[:n] + t]]
            a = self.start * e if a is None else (a[:n] @ self.move) * e
            if t % 8 == 7:
                s = a.sum(1)
                total[:n] += np.log(s)
                a /= s[:, None]
            last = int(np.searchsorted(-size, -(t + 1), "left"))
            if last < n:
                total[last:n] += np.log(a[last:n].sum(1))
        out = np.zeros(len(order))
        out[order] = total
        return out


def segments(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size and whether it begins a text, of the segments that training reads."""
    size = np.diff(first)
    per = -(-size // SEGMENT)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(first[:-1], per) + nth * SEGMENT
    return begin, np.minimum(SEGMENT, np.repeat(first[1:], per) - begin), nth == 0


def expected_counts(model: Model, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One vector of expected counts: starts, moves, emissions, and the log likelihood last."""
    k = len(model.start)
    starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES)), 0.0
    begin, size, fresh = segments(kind, first)
    order = np.argsort(-size, kind="stable")
    share = stationary(model.move)
    table = np.ascontiguousarray(model.emit.T)
    for lo in range(0, len(order), 4096):
        pick = order[lo:lo + 4096]
        b, s = begin[pick], size[pick]
        steps = int(s[0])
        active = [int(np.searchsorted(-s, -t, "left")) for t in range(steps)]
        alphas, scales, emitted = [], [], []
        a = np.where(fresh[pick][:, None], model.start, share)
        for t, n in enumerate(active):
            e = table[kind[b[:n] + t]]
            a = (a if t == 0 else a[:n] @ model.move) * e
            c = a.sum(1, keepdims=True)
            a = a / c
            alphas.append(a)
            scales.append(c)
            emitted.append(e)
        log += float(sum(np.log(c).sum() for c in scales))
        beta = np.ones((active[-1], k))
        gammas = [None] * steps
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k))])
            gammas[t] = alphas[t] * beta
            if t:
                right = emitted[t] * beta / scales[t]
                moves += (alphas[t - 1][:n].T @ right) * model.move
                beta = right @ model.move.T
        starts += gammas[0][fresh[pick]].sum(0)
        where = kind[np.concatenate([b[:n] + t for t, n in enumerate(active)])]
        g = np.concatenate(gammas)
        for i in range(k):
            emits[i] += np.bincount(where, g[:, i], CLASSES)
    return np.concatenate([starts, moves.ravel(), emits.ravel(), [log]])


def stationary(move: np.ndarray) -> np.ndarray:
    p = np.full(len(move), 1 / len(move))
    for _ in range(200):
        p = p @ move
    return p / p.sum()


def first_guess(class_tokens: np.ndarray, states: int, seed: int = 11) -> Model:
    """Sticky states whose emissions are the classes' shares, each disturbed at random."""
    rng = np.random.default_rng(seed)
    share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
    emit = share * np.exp(rng.normal(0, 1, (states, CLASSES)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True), class_tokens, None)


def maximise(model: Model, counts: np.ndarray) -> Model:
    """New parameters from summed expected counts, lightly smoothed."""
    k = len(model.start)
    starts, moves, emits = counts[:k], counts[k:k + k * k].reshape(k, k), counts[k + k * k:-1].reshape(k, CLASSES)
    share = (model.tokens + 0.5) / (model.tokens + 0.5).sum()
    emits = emits + 10 * share
    return Model((starts + 1) / (starts + 1).sum(), (moves + 0.5) / (moves + 0.5).sum(1, keepdims=True),
                 emits / emits.sum(1, keepdims=True), model.tokens, model.types)


def class_sequences(docs: DataFrame) -> DataFrame:
    """``classes``: the class sequence of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, kind, first = batch_tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["classes"])

    return docs.select("text").mapInArrow(run, "classes binary")


def baum_welch(sequences: DataFrame, model: Model, rounds: int) -> Model:
    """Rounds of expectation over all partitions and maximisation of the summed counts.

    Each task sends one number per parameter; the sums are collected, whose count is fixed by states and classes.
    """
    spark = sequences.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                col = batch.column(0)
                for lo in range(0, len(col), 2000):
                    seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in col[lo:lo + 2000]]
                    one = expected_counts(shared.value, np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        summed = sequences.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        if not summed.num_rows:
            break
        counts = np.zeros(summed.num_rows)
        counts[np.asarray(summed["i"])] = np.asarray(summed["v"])
        model = maximise(model, counts)
    return model


def score(docs: DataFrame, learn: Column, states: int = STATES, rounds: int = 3) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``doc_id, text``.

    ``learn`` says which rows the counts and the model are learned from. A null text counts as empty: one end token. Repeated rows
    and rows with a null id are scored each. An empty table gives no rows; without training rows every token is unknown. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    n = parts_of(spark)
    rows = docs.select("doc_id", "text", learn.alias("learn")).withColumn("bucket", range_bucket(docs, "doc_id", 2 * n).cast("int"))
    answers = materialise(answered_words(asked_words(rows, n), n), "hmm-words")
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    stats = answers.where("bucket = -1").select("counts").mapInArrow(_sum_stats, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    for r in stats.collect():  # two numbers per class
        (class_tokens if r["i"] < CLASSES else class_types)[r["i"] % CLASSES] = r["v"]
    sequences = materialise(class_sequences(rows.where("learn")), "hmm-classes")
    model = baum_welch(sequences, first_guess(class_tokens, states), rounds)
    model.types = class_types
    shared = spark.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        n_train, n_types = m.tokens.sum(), m.types.sum()
        words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in right["words"])])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in right["counts"])])
        words, at = np.unique(words, return_index=True)
        counts = counts[at]
        left = left.combine_chunks()
        column = left["text"].combine_chunks() if left.num_rows else pa.array([], pa.string())
        h, kind, first = batch_tokens(column)
        c = counts[np.searchsorted(words, h)].astype(float)
        owner, k = T.owners(first), left.num_rows
        base = np.bincount(owner, np.log10((c + 1) / (n_train + n_types + 1)), k)
        share = np.bincount(owner, np.log10((c + 1) / (m.tokens + m.types + 1)[kind]), k)
        return pa.table({
            "doc_id": left["doc_id"], "n_tokens": pa.array(np.diff(first)),
            "n_known": pa.array(np.bincount(owner, c > 0, k).astype(np.int64)),
            "train_tokens": pa.array(np.full(k, int(n_train), np.int64)), "base_score": pa.array(base),
            "score": pa.array(share + m.likelihoods(kind, first) / np.log(10))})

    asked = answers.where("bucket >= 0")
    return rows.select("bucket", "doc_id", "text").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sum_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            one = np.frombuffer(x.as_buffer(), np.float64)
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])
