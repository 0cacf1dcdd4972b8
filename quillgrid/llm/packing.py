"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

A sequence holds ``capacity`` tokens. Only the histogram of piece lengths is planned (at most ``capacity`` numbers, whatever the corpus),
in two steps. Reduction fixes small sets of lengths that provably do no worse than any other use of their longest piece, many sequences
at a time, and takes them out. Best fit decreasing packs the rest, again by groups of alike sequences. The plan's segments then tell the
place of a piece from its rank among the pieces of its length; ranks come from counts by length and hash bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm import bpe
from quillgrid.llm import textbytes as T
from quillgrid.llm.common import lean, materialise, parts_of

CAPACITY = 2048


@dataclass
class Plan:
    """Segments ``(length, first rank, count, first sequence, pieces a sequence, offset)``: the piece of rank q in a segment lies in
    sequence ``first + (q - rank) // per`` at ``offset + (q - rank) % per * length``."""

    capacity: int
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)
    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def place(self, length: int, count: int, sequence: int, per: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.segments.append((length, rank, count, sequence, per, offset))
        self.used[length] = rank + count

    def fixed(self, lengths: list[int], times: int) -> None:
        """So many sequences that hold exactly these pieces."""
        at = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            self.place(x, per * times, self.sequences, per, at)
            at += per * x
        self.sequences += times


def smallest(count: np.ndarray, n: int) -> list[int]:
    """The n smallest pieces left, or all that are."""
    out: list[int] = []
    for x in np.flatnonzero(count):
        out += [int(x)] * min(n - len(out), int(count[x]))
        if len(out) == n:
            break
    return out


def reduce(count: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets and take their pieces out of ``count`` (by length).

    For the pieces of each length from the longest down: alone, if not even the smallest other fits beside it; with the longest
    fitting piece, if that fills the sequence, or no two others fit together, or it is as long as any fitting pair; with the longest
    fitting piece and one more that fill it exactly, if at most two fit and every fitting pair has one piece no longer than that one.
    """
    capacity = plan.capacity
    for w in range(capacity, 0, -1):
        while count[w]:
            count[w] -= 1
            left = smallest(count, 3)
            room = capacity - w
            fits = np.flatnonzero(count[:room + 1])
            if not len(fits):
                count[w] += 1
                times = int(count[w]) if 2 * w > capacity else 1
                plan.fixed([w], times)
                count[w] -= times
                continue
            best = int(fits[-1])
            if sum(left[:2]) > room or len(left) < 2 or best == room or best >= best_pair(count, room):
                count[w] += 1
                times = int(count[w]) // 2 if best == w else int(min(count[w], count[best]))
                steady = best == room or sum(left[:2]) > room or len(left) < 2
                times = max(1, times if steady else 1)
                plan.fixed([w, best], times)
                count[w] -= times
                count[best] -= times
                continue
            if len(left) < 3 or sum(left) > room:
                other = room - best
                if other and count[other] >= (2 if other == best else 1) and shortest_pair_above(count, other) > room:
                    plan.fixed([w, best, other], 1)
                    count[best] -= 1
                    count[other] -= 1
                    continue
            count[w] += 1
            break


def best_pair(count: np.ndarray, room: int) -> int:
    """The largest sum of two pieces within the room, 0 if none."""
    have = np.flatnonzero(count[:room + 1])
    have = have[have > 0]
    if not len(have):
        return 0
    top = np.searchsorted(have, room - have, "right") - 1
    good = top >= 0
    partner = np.where(good, have[top], 0)
    single = good & (partner == have) & (count[have] < 2)
    partner = np.where(single, np.where(top > 0, have[np.maximum(top - 1, 0)], 0), partner)
    good &= partner > 0
    return int((have + partner)[good].max(initial=0))


def shortest_pair_above(count: np.ndarray, length: int) -> int:
    above = smallest(np.concatenate([np.zeros(length + 1, count.dtype), count[length + 1:]]), 2)
    return sum(above) if len(above) == 2 else 1 << 60


def best_fit(count: np.ndarray, plan: Plan) -> None:
    """Best fit decreasing for what is left; alike sequences are groups ``(first sequence, how many)`` by their room."""
    capacity = plan.capacity
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    for w in range(capacity, 0, -1):
        n = int(count[w])
        count[w] = 0
        while n:
            rooms = np.flatnonzero(open_rooms[w:])
            if len(rooms):
                room = w + int(rooms[0])
                first, many = groups[room].pop()
                open_rooms[room] = bool(groups[room])
            else:
                room, first, many = capacity, plan.sequences, -(-n // (capacity // w))
                plan.sequences += many
            per = room // w
            full = min(many, n // per)
            if full:
                plan.place(w, full * per, first, per, capacity - room)
                n -= full * per
                if room - per * w:
                    groups[room - per * w].append((first, full))
                    open_rooms[room - per * w] = True
            if full < many:
                if n:
                    plan.place(w, n, first + full, n, capacity - room)
                    if room - n * w:
                        groups[room - n * w].append((first + full, 1))
                        open_rooms[room - n * w] = True
                    n, full = 0, full + 1
                if full < many:
                    groups[room].append((first + full, many - full))
                    open_rooms[room] = True


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length, 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    plan = Plan(capacity)
    reduce(count, plan)
    best_fit(count, plan)
    return plan


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's pieces.

    A document is its ids and then the end id, so a null or empty text has one. Longer ones are cut into full pieces, the first taking
    what is over. Repeated rows are packed each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in T.slices(batch.column(1), bpe.SLICE_BYTES):
                ids, first = bpe.encode(buf, off, vocabulary)
                ids = np.insert(ids, first[1:], bpe.END_ID).astype("<u4")
                first = first + np.arange(len(first))
                n = np.diff(first)
                per = -(-n // capacity)
                owner = np.repeat(np.arange(hi - lo), per)
                nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                end = n[owner] - (per[owner] - 1 - nth) * capacity
                start = np.where(nth == 0, 0, end - capacity)
                cut = [ids[a:b].tobytes() for a, b in zip(first[owner] + start, first[owner] + end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + lo)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(end - start),
                     pa.array([zlib.crc32(c) for c in cut], pa.int64()), *([pa.array(cut, pa.binary())] if with_ids else [])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def assign(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``. ``items`` has ``doc_id, piece, length`` and must be stored, as it is read twice."""
    spark = items.sparkSession
    n = parts_of(spark)
    full = items.where(F.col("length") == capacity)
    part = items.where(F.col("length") < capacity).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    sizes = part.groupBy("length", "_bucket").count()
    # At most capacity rows go to the driver; the counts by bucket stay a table.
    plan = make_plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = part.withColumn("_nth", F.row_number().over(within) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_nth") + F.col("_before")).drop("_nth", "_before", "_bucket")
    table = np.array(sorted(plan.segments), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    names = [c for c in ranked.columns if c not in ("_rank", "sequence_id", "offset")]
    ranked = ranked.select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # A segment is found by length and rank at once: ranks lie below 2**50.
        order = (t[:, 0] << 50) + t[:, 1]
        for batch in batches:
            length = np.asarray(batch.column(names.index("length")))
            rank = np.asarray(batch.column(len(names)))
            s = t[np.searchsorted(order, (length << 50) + rank, "right") - 1]
            q = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(s[:, 3] + q // s[:, 4]), pa.array(s[:, 5] + q % s[:, 4] * length)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in names)
    placed = ranked.mapInArrow(lean(run), f"{schema}, sequence_id long, offset long")
    # Full pieces need no plan: each fills a sequence, numbered below zero by the partition it is read in.
    alone = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece of ``docs`` (``doc_id, text``).

    Full pieces take sequences of their own. Sequence numbers are unique, in no order. An empty table gives no rows; other columns are
    ignored.
    """
    return assign(materialise(pieces(docs, capacity, vocabulary, with_ids), "pieces"), capacity)
