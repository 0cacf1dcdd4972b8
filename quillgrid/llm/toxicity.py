"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased bytes, hashed into a fixed number of slots. On the labelled rows each
slot gets the log ratio of its smoothed rate among toxic and clean texts. A logistic regression is trained on the presence of a
slot times this ratio; its product with the ratio is the slot's weight. Scoring is one pass over the texts.

The classifier is fitted on a bounded sample: at most ``max_rows`` labelled rows of each label (those with the smallest hashes of their
ids) and at most ``max_chars`` of their texts; scoring reads every text whole. All training rows are counted, and the bias is shifted from the
sample's share of toxic rows to theirs, so the decision does not hang on how much of either label the sample holds. Slots are counted by tasks; the
driver, which descends, gets the slots that a ratio is given to and the texts' share of these alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import give_back, held_out, lean, materialise

SIZES = (4, 5, 6)
SLOTS = 1 << 20
#: Tasks that share the bounded sample; each counts up to all slots.
SAMPLE_PARTS = 8


def text_slots(buf: np.ndarray, off: np.ndarray, sizes=SIZES, slots: int = SLOTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: slots by position, and each text's first and end position."""
    prefix = T.prefix_hashes(T.BYTE_VALUES[T.LOWER[buf]])
    for size in sizes:
        h = T.window_hashes(prefix, size)
        slot = ((h + np.uint64(size)) & np.uint64(slots - 1)).astype(np.int32)
        start = np.minimum(off[:-1], len(slot))
        yield slot, start, np.maximum(start, np.minimum(off[1:] - size + 1, len(slot)))


def distinct_slots(buf: np.ndarray, off: np.ndarray, sizes=SIZES, slots: int = SLOTS) -> list[np.ndarray]:
    """The distinct slots of each text, sorted."""
    parts = list(text_slots(buf, off, sizes, slots))
    return [np.unique(np.concatenate([s[a[i]:b[i]] for s, a, b in parts])) for i in range(len(off) - 1)]


@dataclass
class Model:
    """Slots with a weight (sorted), their weights, and the bias. A few MB at most: the slots are fixed."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    n_slots: int = SLOTS
    _table: np.ndarray | None = None

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability that each text is toxic; an empty text has the bias alone."""
        if self._table is None:
            self._table = np.zeros(self.n_slots, np.float32)
            self._table[self.slots] = self.weights
        table, n = self._table, len(off) - 1
        total = np.full(n, self.bias)
        found = []
        for slot, start, end in text_slots(buf, off, self.sizes, self.n_slots):
            hit = np.flatnonzero(table[slot])
            owner = np.searchsorted(off, hit, "right") - 1
            keep = (hit >= start[owner]) & (hit < end[owner])
            found.append(owner[keep] * self.n_slots + slot[hit[keep]])
        if found:
            pairs = np.unique(np.concatenate(found))
            total += np.bincount(pairs // self.n_slots, table[pairs % self.n_slots].astype(float), n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, min_texts: int = 3, alpha: float = 1.0, min_ratio: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed rates of slots that stand in so many toxic and clean texts; 0 for those in fewer than ``min_texts`` texts and
    those whose ratio is nearer to 0 than ``min_ratio``."""
    ratio = np.log((toxic + alpha) / (n_toxic + 2 * alpha)) - np.log((clean + alpha) / (n_clean + 2 * alpha))
    ratio[(toxic + clean < min_texts) | (np.abs(ratio) < min_ratio)] = 0
    return ratio


def train(texts: list[np.ndarray], labels: np.ndarray, used: np.ndarray, ratio: np.ndarray, sizes=SIZES, slots: int = SLOTS,
          rounds: int = 200, l2: float = 1.0) -> Model:
    """Logistic regression by accelerated gradient descent. ``used`` are the slots that have a ratio (sorted), a text is its distinct ones by their number there."""
    labels = np.asarray(labels, float)
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -4.0, sizes, slots)
    if not len(labels) or labels.min() == labels.max():
        empty.bias = -4.0 if not len(labels) or labels.max() == 0 else 4.0
        return empty
    prior = float(np.log(labels.mean() / (1 - labels.mean())))
    if not len(used):
        empty.bias = prior
        return empty
    row, col = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in texts]), np.concatenate(texts)
    value = ratio[col]
    step_w = 1.0 / (l2 + 0.25 * float(np.bincount(row, value ** 2, len(labels)).max()) * max(1, len(labels)) ** 0.5)
    w = w_old = np.zeros(len(used))
    b = b_old = prior
    for k in range(rounds):
        m = (k - 1) / (k + 2) if k else 0.0
        y, c = w + m * (w - w_old), b + m * (b - b_old)
        score = c + np.bincount(row, y[col] * value, len(labels))
        error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels
        w_old, b_old = w, b
        w = y - step_w * (np.bincount(col, error[row] * value, len(used)) + l2 * y)
        b = c - min(1.0, 4 / len(labels)) * error.sum() / 2
    weight = w * ratio
    strong = np.abs(weight) > 1e-4
    return Model(used[strong], weight[strong].astype(np.float32), float(b), sizes, slots)


def first_rows(rows: DataFrame, n: int, most: int) -> list[Row]:
    """The first ``most`` of about ``n`` rows in the order of ``_order``, a 64-bit hash, and ``doc_id``.

    Every task sends its own first rows, so only hashes that twice as many rows are expected under are sorted; if that is too few rows, all are.
    """
    if 2 * most < n:
        found = rows.where(F.col("_order") < -(1 << 63) + (2 * most << 64) // n).orderBy("_order", "doc_id").limit(most).collect()
        if len(found) == most:
            return found
    return rows.orderBy("_order", "doc_id").limit(most).collect()


def fit(docs: DataFrame, labels: DataFrame, train_rows=None, max_rows: int = 3000, max_chars: int = 6_000_000) -> Model:
    """A model from labelled documents.

    ``labels`` has ``doc_id`` and ``toxic``; rows with a null in either are left out, and of several labels of an id the largest
    counts; labels without a document are left out. ``train_rows`` is a condition on ``doc_id`` that training rows meet. ``max_rows`` bounds the rows
    of each label, and ``max_chars`` the summed length of the texts of each label; rows are taken in the order of a hash of their id, and a text
    that does not fit is passed over. If none of a label fits, its shortest text is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if train_rows is not None:
        known = known.where(train_rows)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).withColumn("_order", F.xxhash64("doc_id"))
    sizes = docs.select("doc_id", F.length("text").alias("_n")).groupBy("doc_id").agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"))
    sized = materialise(known.join(sizes, "doc_id"), "labelled")
    total = {r["_toxic"]: r["count"] for r in sized.groupBy("_toxic").count().collect()}
    chosen: list[tuple[int, int]] = []
    for value in (0, 1):
        one = sized.where(F.col("_toxic") == value)
        found = first_rows(one.where(F.col("_n") <= max_chars), total.get(value, 0), max_rows)
        taken = 0
        for r in found or one.orderBy("_n", "_order", "doc_id").limit(1).collect():
            if taken == 0 or taken + r["_n"] <= max_chars:
                taken += r["_n"]
                chosen.append((r["doc_id"], value))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, _toxic int")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = materialise(rows.repartition(SAMPLE_PARTS), "sample")
    held = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n_toxic, n_clean = held.get(1, 0), held.get(0, 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_with = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            label = iter(batch.column(1).to_pylist())
            for _, _, buf, off in T.slices(batch.column(0)):
                for d in distinct_slots(buf, off):
                    texts_with[next(label), d] += 1
        seen = np.flatnonzero(texts_with.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(texts_with[v, seen]) for v in (1, 0))], ["slot", "toxic", "clean"])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = ratios(np.asarray(batch.column(1)), np.asarray(batch.column(2)), n_toxic, n_clean)
            keep = np.flatnonzero(ratio)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[keep]), pa.array(ratio[keep])], ["slot", "ratio"])

    def used_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(SLOTS, -1, np.int32)
        index[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            numbers = (index[d] for _, _, buf, off in T.slices(batch.column(0)) for d in distinct_slots(buf, off))
            out = pa.array([c[c >= 0].tobytes() for c in numbers], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], out], ["doc_id", "toxic", "used"])

    used, ratio, texts, toxic = np.zeros(0, np.int32), np.zeros(0), [], np.repeat([0.0, 1.0], [n_clean, n_toxic])
    if n_toxic and n_clean:
        # Most n-grams get no weight. They are counted where the texts are, and only the others are gathered.
        counts = rows.select("text", "_toxic").mapInArrow(lean(counted), "slot int, toxic int, clean int")
        sums = counts.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        found = sums.mapInArrow(lean(rated), "slot int, ratio double").toArrow()
        order = np.argsort(np.asarray(found["slot"]))
        used, ratio = np.asarray(found["slot"])[order], np.asarray(found["ratio"])[order]
        shared = docs.sparkSession.sparkContext.broadcast(used)
        sample = rows.select("text", "doc_id", "_toxic").mapInArrow(lean(used_of), "doc_id long, toxic int, used binary").toArrow()
        order = np.argsort(np.asarray(sample["doc_id"]), kind="stable")
        toxic, numbers = np.asarray(sample["toxic"]).astype(float)[order], sample["used"].combine_chunks()
        texts = [np.frombuffer(numbers[int(i)].as_buffer(), np.int32) for i in order]
    model = train(texts, toxic, used, ratio)
    give_back()
    n = np.bincount([value for _, value in chosen], minlength=2)
    if n.all():
        model.bias += float(np.log(total[1] / total[0]) - np.log(n[1] / n[0]))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``score`` and ``predicted``; a null text counts as empty.

    A clashing ``score`` or ``predicted`` among the kept columns is replaced. Repeated rows are scored alike.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.scores(buf, off) for _, _, buf, off in T.slices(batch.column(0))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                [*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(
        lean(run), f"{schema}, score double, predicted int")


def is_held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return held_out(doc_id, 5, 0)
