"""Conversation prefix trie by splitters and their skeleton.

A conversation is a path: the 16-byte names (MD5) of its turns in order. Paths are sorted as bytes and dealt to shards between splitters,
``(path, conv_id)`` pairs drawn from a bounded sample. A node's members are neighbours in that order, so a node whose members lie in several
shards is a prefix of a splitter's path. These prefixes are the skeleton: a trie of bounded size, broadcast. Each shard walks its sorted paths
once, with one open node for each turn of the path it is at, and finishes every other node by itself. For skeleton nodes it gives partial
counts, which are reduced and then summed up the skeleton. Copies of one path are parted by ``conv_id``, so that even one path that most
conversations share spreads over shards.

A conversation's path is one row, some 20 bytes a turn. Splitters keep the first ``SPLITTER_TURNS`` turns: copies of a longer path stay in
one shard, which streams them. A shard's memory follows the finished nodes that wait for their parent's smallest member.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, parts_of

NAME = 16
#: Sampled paths a shard, turns of a splitter, nodes of a skeleton: with 16 bytes a name the broadcast stays below some 30 MB.
SAMPLE = 8
SPLITTER_TURNS = 512
SKELETON_NODES = 200_000
#: Ids of a piece of a node's ends.
PIECE = 1 << 16
_ROWS = 20_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_OUT = ("part string, node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, first long, ids binary")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order (null first), as structs of ``turn``, ``name`` and ``size`` (code points).

    Null role and text count as empty. Rows of one turn come in the order of their names. Rows without ``conv_id`` belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), name.alias("name"), F.length(text).alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _as_paths(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of the conversations as they are."""
    return _as_paths(ordered_turns(conversations))


def rebuilt_paths(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The like for conversations rebuilt on a common head: the first h turns of conversation ``c - c % group``, then c's own after its
    first h, h being the crc32 of the decimal id modulo ``heads``."""
    own = ordered_turns(conversations)
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.slice(F.coalesce(F.col("_head"), F.slice("turns", 1, 0)), 1, h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    return _as_paths(joined.select("conv_id", F.concat(head, rest).alias("turns")))


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root, parents come before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        self.splitters: list[tuple[bytes, int]] = []
        # Splitters only balance the shards, so any may be left out; short ones come first.
        for path, conv in sorted(splitters, key=lambda s: (len(s[0]), s)):
            if len(self.parent) + len(path) // NAME > SKELETON_NODES:
                break
            self.splitters.append((path, conv))
            node = 0
            for at in range(0, len(path), NAME):
                key = (node, path[at:at + NAME])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(at // NAME + 1)
                node = self.child[key]
        self.splitters.sort()


def skeleton(stored: DataFrame, shards: int, sample: int = SAMPLE) -> Skeleton:
    """Splitters at even places of a sample of ``shards * sample`` paths, drawn by a hash of path and id."""
    cut = F.substring("path", 1, SPLITTER_TURNS * NAME).alias("path")
    drawn = stored.select(cut, "conv_id", F.xxhash64("path", "conv_id").alias("_mix")).orderBy("_mix", "path", "conv_id").limit(shards * sample)
    drawn = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn.collect())
    return Skeleton(sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)} if drawn else []))


class Node:
    """An open node: its skeleton number (-1 outside), last turn's size and what its members so far add up to."""

    __slots__ = ("skeleton", "size", "n", "least", "children", "leaves", "saved", "waiting", "ends", "digest", "any")

    def __init__(self, number: int, size: int):
        self.skeleton, self.size = number, size
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.waiting: list[tuple] = []
        self.ends: list[int] = []
        self.digest, self.any = None, False


class Walk:
    """One pass over a shard's sorted paths. ``rows`` collects what is finished, in the columns of ``_OUT``."""

    def __init__(self, child: dict, piece: int = PIECE):
        self.child, self.piece, self.rows = child, piece, []
        self.start()

    def start(self) -> None:
        self.path, self.open = b"", [Node(0, 0)]

    def add(self, conv: int, path: bytes, sizes) -> None:
        depth = len(self.open) - 1
        if path != self.path:
            same = common(path, self.path)
            while depth > same:
                self.close()
                depth -= 1
            for at in range(same * NAME, len(path), NAME):
                above = self.open[-1].skeleton
                number = self.child.get((above, path[at:at + NAME]), -1) if above >= 0 else -1
                self.open.append(Node(number, sizes[at // NAME]))
            self.path = path
        node = self.open[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(conv)
        if len(node.ends) == self.piece:
            self.put_ends(node)

    def put_ends(self, node: Node) -> None:
        """Pass ends on: into the digest, or as a piece of a skeleton node's."""
        if node.skeleton >= 0:
            self.rows.append(("ends", node.skeleton, *[None] * 8, node.ends[0], np.array(node.ends, "<i8").tobytes()))
        else:
            node.digest = node.digest or hashlib.sha256()
            node.digest.update(told(node.ends, node.any))
            node.any = True
        node.ends = []

    def close(self) -> None:
        depth = len(self.open) - 1
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        if above is not None:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton >= 0:
            if node.ends:
                self.put_ends(node)
            self.rows.append(("partial", node.skeleton, node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, node.size, None))
            return
        if node.digest is None:
            digest = hashlib.sha256(told(node.ends, False)).hexdigest() if node.ends else _EMPTY
        else:
            if node.ends:
                self.put_ends(node)
            digest = node.digest.hexdigest()
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.size
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        own = (node.least, depth, node.n, node.children, leaves, saved, digest)
        if above.skeleton >= 0:
            self.rows.append(("below", above.skeleton, *own[:2], None, *own[2:], None, None))
        else:
            above.waiting.append(own)
        for w in node.waiting:
            self.rows.append(("node", None, *w[:2], node.least, *w[2:], None, None))

    def finish(self) -> None:
        """End the shard."""
        while self.open:
            self.close()
        self.start()


def common(a: bytes, b: bytes) -> int:
    """How many names two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * NAME:middle * NAME] == b[low * NAME:middle * NAME]:
            low = middle
        else:
            high = middle - 1
    return low


def told(ids: list[int], more: bool) -> bytes:
    return (b"," if more else b"") + ",".join(map(str, ids)).encode()


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _OUT.split(", ")])


def walk(dealt: DataFrame, child, piece: int = PIECE) -> DataFrame:
    """Finished nodes, partial counts and ends of every shard; ``dealt`` has ``shard, conv_id, path, sizes``, sorted within tasks."""
    arrow = _schema()

    def batches_of(rows: list) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + _ROWS]), arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, last = Walk(child.value, piece), None
        for batch in batches:
            shards, convs, paths_, sizes = (c.to_pylist() for c in batch.columns)
            for shard, conv, path, size in zip(shards, convs, paths_, sizes):
                if last is not None and shard != last:
                    w.finish()
                last = shard
                w.add(conv, path, size)
                if len(w.rows) >= _ROWS:
                    yield from batches_of(w.rows)
                    w.rows = []
        if last is not None:
            w.finish()
        yield from batches_of(w.rows)

    return dealt.mapInArrow(run, _OUT)


def end_digests(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the pieces of each skeleton node's ends, read in order and hashed as they pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch.column(0)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8").tolist()
                if this != node:
                    if node is not None:
                        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})
                    node, digest = this, hashlib.sha256(told(ids, False))
                else:
                    digest.update(told(ids, True))
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})

    ordered = pieces.repartition(parts_of(pieces.sparkSession), "node").sortWithinPartitions("node", "first")
    return ordered.mapInArrow(run, "node long, ends_sha256 string")


def _summed(parts: list, frame: Skeleton) -> list[tuple]:
    """The skeleton's nodes from their reduced counts: children's leaves and savings go up, deepest first."""
    counts = {r["node"]: r for r in parts}
    children, leaves, saved = (dict.fromkeys(counts, 0) for _ in range(3))
    out = []
    for k in sorted(counts, key=lambda k: -frame.depth[k]):
        r, up = counts[k], frame.parent[k]
        children[k] += r["n_children"]
        leaves[k] = leaves[k] + r["n_leaves"] if children[k] else 1
        saved[k] += r["saved_tokens"] + (r["n_convs"] - 1) * r["size"]
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
        out.append((k, r["conv_id"], frame.depth[k], counts[up]["conv_id"] if up >= 0 else None, r["n_convs"], children[k], leaves[k], saved[k]))
    return out


def trie(found: DataFrame, shards: int | None = None, piece: int = PIECE) -> DataFrame:
    """Every node of the trie of ``found`` (``conv_id, path, sizes``; one row a conversation): ``conv_id`` (its smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``saved_tokens`` sums over a node's subtree the members beyond the first times the size of the last turn; ``ends_sha256`` is the digest
    of the ids of the conversations that end at the node. No conversations give no nodes.
    """
    spark = found.sparkSession
    shards = shards or parts_of(spark)
    stored = materialise(found, "paths")
    frame = skeleton(stored, shards)
    splitters = spark.sparkContext.broadcast(frame.splitters)
    child = spark.sparkContext.broadcast(frame.child)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            shard = pa.array([bisect_right(splitters.value, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], ["shard", "conv_id", "path", "sizes"])

    dealt = stored.mapInArrow(deal, "shard int, conv_id long, path binary, sizes array<int>")
    dealt = dealt.repartitionById(len(frame.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    walked = materialise(walk(dealt, child, piece), "walked")
    # The skeleton is bounded by SKELETON_NODES, so its reduced counts may go through the driver.
    partial = walked.where("part = 'partial'").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("first").alias("size"))
    nodes = spark.createDataFrame(_summed(partial.collect(), frame), "node long, conv_id long, depth long, parent_conv_id long, n_convs long, "
                                  "n_children long, n_leaves long, saved_tokens long")
    ends = end_digests(walked.where("part = 'ends'").select("node", "first", "ids"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).select(columns)
    above = F.broadcast(nodes.select("node", F.col("conv_id").alias("_above")))
    below = walked.where("part = 'below'").drop("parent_conv_id").join(above, "node").withColumnRenamed("_above", "parent_conv_id").select(columns)
    splitters.destroy()
    child.destroy()
    return walked.where("part = 'node'").select(columns).unionByName(below).unionByName(top)
