"""N-gram Jaccard join with a count-vector R-tree: documents whose word n-gram sets are alike, exactly.

A set's n-grams are hashed into groups; the counts of the groups are a point (folded to 64 groups in the tree, finer at its leaves and for a pair). The overlap of two sets is at most the sum of the smaller
counts, and of a set and all points of a tree node at most that with the node's largest counts; so a tree over the points finds the
pairs that may be alike, and these are compared whole.

What meets in a tree is decided by prefixes: in one order of all n-grams (frequent ones last, else by hash), two sets of similarity t share
one of their first n - ceil(t n) + 1 n-grams. Equal sets are one node of the link graph. As components are asked for and not pairs, a
group of sets with a common key is first compared with its hub only, the set with most frequent n-grams; sets that so fall into one
component need no further comparison, and the tree takes the pairs of different components that are left. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import hinted, lean, materialise, parts_of
from quillgrid.llm.components import components

SIZE, PERCENT, GROUPS = 5, 80, 64
LEAF = 16
#: N-grams counted as frequent: an estimate of this many documents; the list that all tasks hold is bounded. It only orders.
FREQUENT, MOST_FREQUENT = 200, 200_000
_SAMPLE = 64


def gram_sets(buf: np.ndarray, off: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter sequence of words counts as one n-gram."""
    h, first = T.word_hashes(buf, off)
    grams = T.gram_hashes(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        else:
            out.append(T.gram_hashes(h[a:b], b - a) if b > a else grams[:0])
    return out


_HASH = (1 << 57) - 1


def set_hash(grams: np.ndarray) -> int:
    """57 bits that stand for a whole set."""
    return int(T.mix(np.array([T.mix(grams).sum() + np.uint64(len(grams))], np.uint64))[0]) >> 7


def needed(a, b, percent: int = PERCENT):
    """The least overlap of sets of these sizes that makes them alike: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def point(grams: np.ndarray) -> np.ndarray:
    """Counts of a set's n-grams by group. Larger sets have more groups, a power of two of them, which fold down to fewer."""
    groups = max(GROUPS, min(1 << len(grams).bit_length(), 1 << 13))
    return np.bincount((T.mix(grams) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes where they fit, else as 32-bit numbers behind a mark; their number is a power of two."""
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\0" + counts.astype("<u4").tobytes()


def unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return (raw if len(raw) % 2 == 0 else raw[1:].view("<u4")).astype(np.int32)


def folded(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(0)


def coarse_point(counts: np.ndarray, size: int) -> np.ndarray:
    """A point folded to a group for every 8 to 16 n-grams: with fewer groups, unlike large sets have much the same counts."""
    return folded(counts, min(len(counts), max(GROUPS, 1 << (size >> 4).bit_length())))


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    """No two sets of these points share more n-grams."""
    n = min(len(p), len(q))
    return int(np.minimum(folded(p, n), folded(q, n)).sum())


class CountTree:
    """An R-tree over count vectors, packed bottom up in the order of set size and largest groups.

    Nodes keep the largest counts, the range of sizes, and the component if it is a single one.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((counts.argmax(1) if len(counts) else sizes, sizes))
        self.counts, self.sizes, self.labels = counts[self.order], sizes[self.order], labels[self.order]
        self.levels = [(self.counts, self.sizes, self.sizes, self.labels, np.ones(len(sizes), bool))]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high, label, single = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            least, most = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                least, (least == most) & np.logical_and.reduceat(single, at)))

    def pairs(self, percent: int = PERCENT, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (as given) of different labels whose bound allows them to be alike, each once."""
        n = len(self.sizes)
        todo = []
        last = len(self.levels) - 1
        for lo in range(0, n, 256):
            q = np.arange(lo, min(n, lo + 256))
            k = len(self.levels[last][0])
            todo.append((last, np.repeat(q, k), np.tile(np.arange(k), len(q))))
        while todo:
            level, query, node = todo.pop()
            top, low, high, label, single = self.levels[level]
            size = self.sizes[query]
            keep = (100 * high[node] >= percent * size) & (100 * size >= percent * low[node]) & ~(single[node] & (label[node] == self.labels[query]))
            if not level:
                keep &= node > query
            query, node, size = query[keep], node[keep], size[keep]
            keep = np.zeros(len(query), bool)
            for a in range(0, len(query), chunk):
                q, m = query[a:a + chunk], node[a:a + chunk]
                bound = np.minimum(self.counts[q], top[m]).sum(1)
                keep[a:a + chunk] = bound >= needed(size[a:a + chunk], np.maximum(low[m], -(-percent * size[a:a + chunk] // 100)), percent)
            query, node = query[keep], node[keep]
            if not len(query):
                continue
            if not level:
                yield self.order[query], self.order[node]
                continue
            below = len(self.levels[level - 1][0])
            child = node[:, None] * LEAF + np.arange(LEAF)
            inside = child < below
            query, child = np.broadcast_to(query[:, None], child.shape)[inside], child[inside]
            todo += [(level - 1, query[a:a + (1 << 18)], child[a:a + (1 << 18)]) for a in range(0, len(query), 1 << 18)]


def finer(points: list[np.ndarray], sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int = PERCENT, cells: int = 1 << 21) -> np.ndarray:
    """Whether each pair of points (by number) may be alike by as many groups as both have."""
    groups = np.array([len(p) for p in points])
    both = np.minimum(groups[x], groups[y])
    keep = np.ones(len(x), bool)
    for n in np.unique(both[both > GROUPS]).tolist():
        at = np.flatnonzero(both == n)
        step = max(1, cells // n)
        for pick in (at[a:a + step] for a in range(0, len(at), step)):
            p, q = (np.stack([folded(points[i], n) for i in ends]) for ends in (x[pick].tolist(), y[pick].tolist()))
            keep[pick] = np.minimum(p, q).sum(1) >= needed(sizes[x[pick]], sizes[y[pick]], percent)
    return keep


def frequent_grams(docs: DataFrame, size: int) -> np.ndarray:
    """The n-grams of an estimated ``FREQUENT`` documents or more, the most frequent ones if there are too many to hold.

    Per batch, n-grams of several documents count exactly, others by a sample of one in 64 with its weight.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            sets = [s for _, _, buf, off in T.slices(batch.column(0)) for s in gram_sets(buf, off, size)]
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            u, n = np.unique(every, return_counts=True)
            salt = u[:1] if len(u) else u
            picked = (n > 3) | (T.mix(u ^ (salt if len(salt) else np.uint64(i))) % np.uint64(_SAMPLE) == 0)
            weight = np.where(n > 3, n, n * _SAMPLE)
            yield pa.RecordBatch.from_arrays([pa.array(u[picked].view(np.int64)), pa.array(weight[picked])], ["g", "n"])

    found = docs.select("text").mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).select("g").toArrow()
    return np.sort(np.asarray(top["g"].combine_chunks() if top.num_rows else pa.array([], pa.int64())).view(np.uint64))


def signatures(docs: DataFrame, frequent, size: int, percent: int) -> DataFrame:
    """``doc_id, n, node, usual, counts, coarse, keys``: set size, set id, how many of the first keys are frequent ones, the point, the
    point folded, the prefix.

    ``node`` has the share of frequent n-grams in its first 7 bits, then 57 bits of a hash of the whole set; null for an empty set. Of equal
    sets in a batch only the first carries keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = frequent.value
        for batch in batches:
            seen: set[int] = set()
            n, nodes, common, counts, coarse, keys = [], [], [], [], [], []
            for _, _, buf, off in T.slices(batch.column(1)):
                for s in gram_sets(buf, off, size):
                    n.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        common.append(0)
                        counts.append(None)
                        coarse.append(None)
                        keys.append(None)
                        continue
                    at = np.minimum(np.searchsorted(usual, s), max(0, len(usual) - 1))
                    is_usual = usual[at] == s if len(usual) else np.zeros(len(s), bool)
                    share = int(is_usual.sum() * 127 // len(s))
                    node = (share << 57 | set_hash(s)) - (1 << 63)
                    nodes.append(node)
                    if node in seen:
                        common.append(0)
                        counts.append(None)
                        coarse.append(None)
                        keys.append(None)
                        continue
                    seen.add(node)
                    counts.append(packed(at := point(s)))
                    coarse.append(packed(coarse_point(at, len(s))))
                    k = len(s) - -(-percent * len(s) // 100) + 1
                    rare = s[~is_usual][:k]
                    rest = s[is_usual][:k - len(rare)]
                    common.append(len(rest))
                    keys.append(np.concatenate([rest, rare]).view(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(common, pa.int32()), pa.array(counts, pa.binary()),
                 pa.array(coarse, pa.binary()), pa.array(keys, pa.binary())],
                ["doc_id", "n", "node", "usual", "counts", "coarse", "keys"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, node long, usual int, counts binary, coarse binary, keys binary")


def prefix_keys(signed: DataFrame) -> DataFrame:
    """``key, node, is_usual``: one row per set and key of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, usual = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo in range(0, batch.num_rows, 2000):
                parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)[lo:lo + 2000]]
                size = np.array([len(p) for p in parts])
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts)), pa.array(np.repeat(node[lo:lo + 2000], size)), pa.array(place < np.repeat(usual[lo:lo + 2000], size))],
                    ["key", "node", "is_usual"])

    return signed.where("keys is not null").select("node", "usual", "keys").mapInArrow(lean(run), "key long, node long, is_usual boolean")


def shared_keys(keys: DataFrame, n: int) -> DataFrame:
    """``key, node, hub``: the rows whose key several sets have.

    Rare keys are dealt by key once, for both the hub and the join. For frequent ones, of which there are a bounded number, hubs are
    found by map-side combining and broadcast, so a key that a third of all sets have is never gathered.
    """
    def hubs(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max("node").alias("hub"), F.min("node").alias("_low")).where("hub <> _low").select("key", "hub")

    rare = keys.where(~F.col("is_usual")).select("key", "node").repartition(n, "key")
    usual = keys.where("is_usual").select("key", "node")
    return rare.join(hubs(rare).hint("shuffle_hash"), "key").union(usual.join(F.broadcast(hubs(usual)), "key"))


def sets_of(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, grams``: the whole sets of the nodes asked for, from one document of each."""
    wanted = materialise(firsts.join(nodes, "node").select("doc_id", "node"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, buf, off in T.slices(batch.column(1)) for s in gram_sets(buf, off, size)]
            # An id may stand on rows of several texts; only the node's own set counts.
            own = [x is not None and x & _HASH == set_hash(s) for s, x in zip(sets, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(own, pa.bool_())), pa.array([s.view(np.int64).tobytes() for s, o in zip(sets, own) if o], pa.binary())],
                ["node", "grams"])

    return docs.join(hinted(wanted), "doc_id").select("node", "text").mapInArrow(lean(run), "node long, grams binary").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.int64).view(np.uint64), np.frombuffer(y.as_buffer(), np.int64).view(np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                good.append(100 * i >= percent * (len(p) + len(q) - i))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("_p"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("_q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_p", "_q").mapInArrow(lean(run), "a long, b long")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The stored pairs whose points (``node, n, counts``) allow them to be alike. ``points`` may hold a node more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (np.asarray(batch.column(i)) for i in (2, 4))
            p, q = ([unpacked(x.as_buffer()) for x in batch.column(i)] for i in (3, 5))
            keep = pa.array(np.array([overlap_bound(x, y) for x, y in zip(p, q)], np.int64) >= needed(m, n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = points.select(F.col("node").alias("a"), F.col("n").alias("_m"), F.col("counts").alias("_p"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("counts").alias("_q"))
    # Few points are asked for: the pairs go to them, and not all points to the pairs.
    half = left.join(hinted(pairs), "a")
    other = right.join(hinted(materialise(pairs.select("b").distinct(), "ends")), "b")
    return half.join(other, "b").select("a", "b", "_m", "_p", "_n", "_q").mapInArrow(lean(run), "a long, b long").distinct()


def tree_pairs(groups: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: pairs of different components that the trees of the groups (``key, node, root, n, coarse``) let through, each once.

    A tree gives one row per set with its partners packed, so that a pair that several keys find is put together before it is a row.
    """
    def search(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        node = np.asarray(table["node"])
        points, sizes = [unpacked(x.as_buffer()) for x in table["coarse"]], np.asarray(table["n"])
        tree = CountTree(np.stack([folded(p) for p in points]), sizes, np.asarray(table["root"]))
        for x, y in tree.pairs(percent):
            keep = finer(points, sizes, x, y, percent)
            x, y = x[keep], y[keep]
            if len(x):
                yield packed_rows(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]))

    def packed_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        cut = [*head.tolist(), len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array([b[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())], ["a", "bs"])

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.asarray(batch.column(0))
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cut, cut[1:]):
                if held and held[0].column(0)[0].as_py() != key[a]:
                    yield held
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            yield from search(group)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            b = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for g in group for x in g.column(1)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), group[0].column(0)[0].as_py(), np.int64)), pa.array(b)], ["a", "b"])

    found = groups.select("key", "node", "root", "n", "coarse").repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, bs binary")
    return found.repartition(n, "a").sortWithinPartitions("a").mapInArrow(lean(unpack), "a long, b long")


def similar(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``doc_id, text``.

    Words are runs without ASCII white space, A to Z in lower case; a set holds the distinct runs of ``size`` words, a shorter text its
    whole sequence, a text without words (or null) nothing. Sets are linked whose similarity is ``percent`` or more; empty ones with
    none. The component is its smallest id, a null id being the smallest. Rows of one id keep each their own set; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = parts_of(spark)
    absent = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), absent).alias("doc_id"), F.col("text").cast("string"))
    frequent = spark.sparkContext.broadcast(frequent_grams(rows, size))
    signed = materialise(signatures(rows, frequent, size, percent), "sets")
    firsts = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    points = signed.where("counts is not null").select("node", "n", "counts")
    shared = materialise(shared_keys(prefix_keys(signed), n), "keys")
    hub_pairs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    coarse = materialise(signed.where("coarse is not null").select("node", "n", "coarse").dropDuplicates(["node"]), "coarse")
    # Small points go along with all pairs, large ones with those that are left.
    near_hubs = materialise(bounded(materialise(hub_pairs, "hubs"), coarse.withColumnRenamed("coarse", "counts"), percent), "near")
    first_pairs = materialise(bounded(near_hubs, points, percent), "pairs")
    links = _verified(first_pairs, firsts, rows, size, percent)
    roots = materialise(components(links), "roots")
    labelled = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Groups of several components; groups of the same sets are one.
    open_keys = labelled.groupBy("key").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"),
    ).where("x <> y").groupBy("c", "s", "x", "y").agg(F.min("key").alias("key")).select("key")
    groups = labelled.join(open_keys, "key").dropDuplicates(["key", "node"]).join(coarse, "node")
    more_pairs = materialise(bounded(materialise(tree_pairs(groups, n, percent), "trees"), points, percent), "pairs")
    more_links = _verified(more_pairs, firsts, rows, size, percent)
    roots = components(links.union(more_links)) if more_links.take(1) else roots
    nodes = signed.select("doc_id", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("_c"))
    return nodes.join(least, "root", "left").select(
        F.nullif("doc_id", absent).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("_c", "doc_id"), absent).alias("component_id"))


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(sets_of(nodes, firsts, docs, size), "grams")
    return materialise(alike(pairs, sets, percent), "alike")
