"""Document fingerprints by locally consistent parsing.

The bytes of a text are parsed into phrases, these into phrases of phrases, and so on. In each round runs of one name become a single
name, deterministic coin tossing turns the names into a few small labels (each from the lowest bit in which a name differs from the
one before), and a phrase begins at every local maximum of the labels. A phrase's name is a hash of the names in it. Boundaries depend
on a few neighbours alone, so equal substrings get equal names inside, whatever their offset.

The fingerprint keeps, in 64 bins of the hash space, the smallest hash of the names from the second round up, 16 bits each. The share of
bins in which two fingerprints agree estimates how much of their phrases the texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import parts_of, range_bucket

BINS = 64
#: Rounds before names count: short phrases are shared by unlike texts.
SKIPPED = 2
_EMPTY = np.uint64((1 << 64) - 1)


def _runs(symbol: np.ndarray, fresh: np.ndarray) -> np.ndarray | None:
    """Where runs of one symbol begin; None if every symbol is a run."""
    new = fresh.copy()
    new[1:] |= symbol[1:] != symbol[:-1]
    return None if new.all() else np.flatnonzero(new)


def _toss(symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The lowest bit in which a symbol differs from the one before, and its value there."""
    kind = symbol.dtype.type
    differ = symbol ^ before
    low = np.bitwise_count((differ & (~differ + kind(1))) - kind(1))
    return ((low << np.uint8(1)) | ((symbol >> low) & kind(1)).astype(np.uint8)) & np.uint8(127)


_PAIR = np.arange(128, dtype=np.uint8)
#: One more toss of labels below 128, by the label before and the label.
_AGAIN = _toss(np.tile(_PAIR, 128), np.repeat(_PAIR, 128))


def _labels(symbol: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Small labels, neighbours differing, from symbols whose neighbours differ. ``fresh`` marks the first of a text."""
    first = np.flatnonzero(fresh)
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[first] = ~symbol[first]
    label = _toss(symbol, before)
    for _ in range(3):
        pair = label.astype(np.int32)
        pair[1:] += label[:-1].astype(np.int32) << 7
        pair[first] = (127 - label[first].astype(np.int32) << 7) + label[first]
        label = _AGAIN[pair]
    return label


def _round(name: np.ndarray, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one round, from names and the symbols that are tossed for them."""
    n = len(name)
    fresh = np.ones(n, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    at = _runs(symbol, fresh)
    if at is not None:
        run = np.diff(np.append(at, n)).astype(np.uint64)
        name, symbol, owner, fresh, n = name[at], symbol[at], owner[at], fresh[at], len(at)
        name = np.where(run > 1, T.mix(name + run * np.uint64(0x9E3779B97F4A7C15)), name)
    label = _labels(symbol, fresh)
    # A text's first name begins a phrase; so does every local maximum.
    top = fresh.copy()
    top[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~fresh[2:]
    start = np.flatnonzero(top)
    prefix = T.prefix_hashes(name)
    return T.span_hashes(prefix, start, np.append(start[1:], n)), owner[start]


def sketches(buf: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest name hash per text and bin; ``_EMPTY`` where a bin has none."""
    n = len(off) - 1
    out = np.full(n * bins, _EMPTY, np.uint64)
    name, symbol, owner = T.BYTE_VALUES[buf], buf, np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    level = 0
    while len(name):
        name, owner = _round(name, symbol, owner)
        level += 1
        done = np.bincount(owner, minlength=n)[owner] == 1
        counted = done if level < SKIPPED else slice(None)
        h = T.mix(name[counted] + np.uint64(level >= SKIPPED))
        np.minimum.at(out, owner[counted] * bins + (h % np.uint64(bins)).astype(np.int64), h)
        name, owner = name[~done], owner[~done]
        symbol = name.astype(np.uint32)
    return out.reshape(n, bins)


def as_text(sketch: np.ndarray) -> list[str]:
    """Four hexadecimal digits a bin, ``----`` for an empty one."""
    folded = ((sketch >> np.uint64(40)) & np.uint64(0xFFFF)).astype(">u2")
    empty = sketch == _EMPTY
    out = []
    for row, gaps in zip(folded, empty):
        s = row.tobytes().hex()
        if gaps.any():
            s = "".join("----" if g else s[4 * i:4 * i + 4] for i, g in enumerate(gaps))
        out.append(s)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins either sketch fills in which they agree, row by row; 1 where both are empty."""
    fill_a, fill_b = a != _EMPTY, b != _EMPTY
    same = (((a ^ b) >> np.uint64(40)) & np.uint64(0xFFFF) == 0) & fill_a & fill_b
    either = (fill_a | fill_b).sum(-1)
    return np.where(either > 0, same.sum(-1) / np.maximum(either, 1), 1.0)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint`` (replaced if there); a null text counts as empty."""
    names = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [p for _, _, buf, off in T.slices(batch.column(0)) for p in as_text(sketches(buf, off))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints, pa.string())], [*names, "fingerprint"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(F.col(text).cast("string").alias("_text"), *[F.col(f"`{c}`") for c in names]).mapInArrow(
        run, f"{schema}, fingerprint string")


def with_successors(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Documents dealt into ranges of ``doc_id`` (``part``), each sorted and followed by a copy of its successor (``guard`` 1).

    The successor of a range is the first document of the next range that has any, after the last that of the first. Repeated ids are
    taken in the order of their texts, a null id comes first.
    """
    n = parts_of(spark)
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = dealt.withColumn("part", range_bucket(dealt, "doc_id", n).cast("int"))
    heads = sorted(((r["part"], r["id"]) for r in dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("id")).collect()))
    # One row per range: where a copy of its first document goes.
    before = {part: heads[i - 1][0] for i, (part, _) in enumerate(heads)}
    first = {part: i for part, i in heads}
    if not heads:
        return dealt.withColumn("guard", F.lit(0))
    is_head = F.create_map(*[F.lit(x) for part, i in first.items() for x in (part, -1 if i is None else i)])
    target = F.create_map(*[F.lit(x) for part, to in before.items() for x in (part, to)])
    guards = dealt.where(F.coalesce("doc_id", F.lit(-1)) == is_head[F.col("part")]).select("doc_id", "text", target[F.col("part")].alias("part"), F.lit(1).alias("guard"))
    return dealt.withColumn("guard", F.lit(0)).unionByName(guards).repartition(n, "part").sortWithinPartitions("part", "guard", "doc_id", "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    The edited text has its last quarter (rounded down, in code points) replaced by the first as many of the next document's, in the
    order of ``doc_id``, after the last the first. A lone document is its own successor. Null texts count as empty.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document whose successor comes next
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts, part, guard = (batch.column(i)[lo:lo + 256].to_pylist() for i in range(4))
                rows = list(zip(ids, texts, part, guard))
                if held is not None:
                    rows.insert(0, held)
                done, held = _pairs(rows)
                if done is not None:
                    yield done

    return with_successors(docs, docs.sparkSession).select("doc_id", "text", "part", "guard").mapInArrow(run, schema)


def _pairs(rows: list[tuple]) -> tuple[pa.RecordBatch | None, tuple | None]:
    """Result rows of the documents whose successor is among the rows, and the last row if it waits for one."""
    todo = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
    held = rows[-1] if rows and not rows[-1][3] else None
    if not todo:
        return None, held
    quarter = [len(a[1]) // 4 for a, _ in todo]
    edited = [a[1][:len(a[1]) - q] + b[1][:q] for (a, b), q in zip(todo, quarter)]
    both, changed = (np.concatenate([sketches(buf, off) for _, _, buf, off in T.slices(pa.array(x, pa.string()))])
                     for x in ([r[1] for r in rows], edited))
    at = np.array([i for i, (a, b) in enumerate(zip(rows, rows[1:])) if not a[3] and a[2] == b[2]])
    own, near = both[at], both[at + 1]
    return pa.RecordBatch.from_arrays(
        [pa.array([a[0] for a, _ in todo], pa.int64()), pa.array([len(a[1]) for a, _ in todo], pa.int64()),
         pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(as_text(own)), pa.array(as_text(changed)),
         pa.array(likeness(own, changed)), pa.array(likeness(own, near))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]), held
