"""Benchmark decontamination: word pairs seed candidates by exact bounds, Smith-Waterman alignment decides.

An item is found in a document if their best local alignment has at least ``share`` of the best possible score. Of an item with k words such an
alignment leaves out or replaces u and puts in v with 3u + v <= B = 2k(1 - share). So at least k - 1 - 2B/3 of the item's k - 1 pairs of
neighbours stand in it with no or one word between, on diagonals (place in the document less place in the item) within B of each other. Items too short for this
bound are sought by single words, of which at least share * k match.

Rarity changes the work alone: the item's most frequent seeds by a count of documents are not looked for, as many as the bound leaves over, and the others
must meet what remains of it. Where they do, the words around are aligned locally with the item.

Items are taken in blocks of a fixed number of words, so what a task holds of the benchmark is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T
from quillgrid.llm.common import hinted, lean, materialise

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the items that one scan looks for.
BLOCK_WORDS = 500_000
#: Pairs of a hit and an item that are looked at together, more only within one text.
MOST_PAIRS = 1_000_000


def clean_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without ASCII punctuation at either end; words of nothing else are left out."""
    start, end, _ = T.words(buf, off)
    low = T.LOWER[buf]
    solid = (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
    where = np.flatnonzero(solid)
    before = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(solid, out=before[1:])
    a, b = before[start], before[end]
    keep = b > a
    start, end = where[a[keep]], where[b[keep] - 1] + 1
    return T.span_hashes(T.prefix_hashes(T.BYTE_VALUES[low]), start, end), np.searchsorted(start, off)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and the first and end word of the second in it (linear gaps).

    Row by row over the item; gaps along the other sequence come from a running maximum.
    """
    n = len(words)
    slope = GAP * np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, at, came = 0, 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        score = np.concatenate([[0], np.maximum(diagonal, up)])
        source = np.concatenate([[0], np.where(diagonal >= up, begin[:-1], begin[1:])])
        fresh = score <= 0
        score[fresh], source[fresh] = 0, np.flatnonzero(fresh)
        # A gap from an earlier column: the largest score less the gap's length.
        lead = np.maximum.accumulate(score - slope)
        origin = np.maximum.accumulate(np.where(score - slope == lead, np.arange(n + 1), 0))
        better = lead + slope > score
        score = np.where(better, lead + slope, score)
        source = np.where(better, source[origin], source)
        row, begin = score, source
        top = int(row.argmax())
        if row[top] > best:
            best, at, came = int(row[top]), top, int(begin[top])
    return best, came, at


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, in order."""
    return T.mix(a * np.uint64(0x2545F4914F6CDD1D) + b)


class Items:
    """A block of test items: their words, and their seeds in a sorted table.

    ``need`` is how many of an item's seeds any alignment holds that scores ``share``, and ``spread`` how far apart their diagonals lie at most.
    """

    def __init__(self, ids: list[int], texts: list[str], share: float):
        self.ids = ids
        buf, off = T.column_bytes(pa.array(texts, pa.string()))
        h, first = clean_words(buf, off)
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        self.size = k = np.diff(first)
        self.spread = np.floor(2 * k * (1 - share) + 1e-9).astype(np.int64)
        pairs = k - 1 - 2 * self.spread // 3
        single = pairs < 1
        self.single = bool((single & (k > 0)).any())
        self.need = np.where(single, np.maximum(1, np.ceil(share * k - 1e-9)), pairs).astype(np.int64)
        grams, owner, place = [], [], []
        for i, w in enumerate(self.words):
            g = w if single[i] else pair_hashes(w[:-1], w[1:])
            grams.append(g)
            owner.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        g, o, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owner, place))
        g = g.astype(np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, self.owner, self.place = g[order], o[order], p[order]
        self.table = np.unique(self.grams)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.table & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and place in the table of every seed in the texts, in the order of texts."""
        text, word, found = [], [], []
        for apart in range(0 if self.single else 1, 3):
            g = h if not apart else pair_hashes(h[:-apart], h[apart:])
            near = np.flatnonzero(self.filter[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.table, g[near]), len(self.table) - 1)
            same = self.table[place] == g[near]
            near, place = near[same], place[same]
            owner = np.searchsorted(first, near, "right") - 1
            whole = near + apart < first[owner + 1]
            text.append(owner[whole])
            word.append(near[whole])
            found.append(place[whole])
        text, word, found = np.concatenate(text), np.concatenate(word), np.concatenate(found)
        order = np.argsort(text, kind="stable")
        return text[order], word[order], found[order]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items of non-empty text in blocks of about ``block`` words, through the driver one at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += r[1].count(" ") + 1
        if size >= block:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, block: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, score, n_matched, first_word, end_word``: for every document and item that align by at least ``share``, the best
    alignment.

    Scores lie between 0 and 1; ``n_matched`` counts the seeds met around the alignment; words are counted among those that hold a letter or digit. Texts that are null or empty match nothing.
    Of rows with the same id the best alignment is given; a null id is kept as one. No items or no documents: no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, n_matched int, first_word int, end_word int"
    out = None
    for ids, texts in _blocks(benchmark, block):
        items = Items(ids, texts, share)
        if not len(items.table):
            continue
        shared = spark.sparkContext.broadcast(items)
        seeds = spark.sparkContext.broadcast(_seeds(rows, shared))
        found = rows.mapInArrow(lean(_aligner(shared, seeds, share)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_matched", -F.col("first_word"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.n_matched", (-F.col("b.col3")).alias("first_word"), "b.end_word")


def _seeds(rows: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the items' seeds whether it is looked for, and for each item how many of these an alignment must meet.

    Of the ``need`` seeds that an alignment holds, at most as many as are dropped can be among the dropped ones. The counts collected are bounded by
    the block.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = np.zeros(len(items.table), np.int64)
        for batch in batches:
            for _, _, buf, off in T.slices(batch.column(0)):
                text, _, at = items.hits(*clean_words(buf, off))
                both = np.unique(text * len(items.table) + at)
                total += np.bincount(both % len(items.table), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "n"])

    items = shared.value
    df = np.zeros(len(items.table), np.int64)
    found = rows.select("text").mapInArrow(lean(count), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    if found.num_rows:
        df[np.asarray(found["i"])] = np.asarray(found["n"])
    entry = df[np.searchsorted(items.table, items.grams)]
    least = (items.need + 1) // 2
    order = np.lexsort((items.place, -entry, items.owner))
    owner = items.owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    seed = np.zeros(len(entry), bool)
    seed[order] = rank >= (items.need - least)[owner]
    return seed, least


def _aligner(shared, seeds, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (seed, least) = shared.value, seeds.value
        # Entries that are looked for, by place in the table.
        owner, place = items.owner[seed], items.place[seed]
        begins = np.searchsorted(items.grams[seed], items.table, "left")
        counts = np.searchsorted(items.grams[seed], items.table, "right") - begins
        for batch in batches:
            out: list[tuple] = []
            for lo, _, buf, off in T.slices(batch.column(1)):
                h, first = clean_words(buf, off)
                texts, words, at = items.hits(h, first)
                for p, q in _pieces(texts, counts[at]):
                    begin, n = begins[at[p:q]], counts[at[p:q]]
                    entry = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    text, item, start = np.repeat(texts[p:q], n), owner[entry], np.repeat(words[p:q], n) - place[entry]
                    for a, b in _stretches(text, item, start, least, items.spread):
                        k, wide = int(items.size[a[1]]), int(items.spread[a[1]])
                        base, end = int(first[a[0]]), int(first[a[0] + 1])
                        x, y = max(base, a[2] - wide), min(end, b[0] + wide + k)
                        w = items.words[a[1]]
                        # No more words match than the stretch holds of the item.
                        if np.isin(w, h[x:y]).sum() < share * k:
                            continue
                        score, came, to = align(w, h[x:y])
                        if score >= share * MATCH * k:
                            out.append((batch.column(0)[lo + a[0]].as_py(), items.ids[a[1]], score / (MATCH * k), b[1], x + came - base, x + to - base))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))],
                    ["doc_id", "item_id", "score", "n_matched", "first_word", "end_word"])
    return run


def _pieces(text: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of hits, whole texts each, that stand for about ``MOST_PAIRS`` pairs of a hit and an item."""
    total = np.cumsum(n)
    p = 0
    while p < len(text):
        q = int(np.searchsorted(total, (total[p - 1] if p else 0) + MOST_PAIRS, "right"))
        q = max(int(np.searchsorted(text, text[min(q, len(text) - 1)], "left")) if q < len(text) else len(text), int(np.searchsorted(text, text[p], "right")))
        yield p, q
        p = q


def _stretches(text: np.ndarray, item: np.ndarray, start: np.ndarray, least: np.ndarray, spread: np.ndarray) -> Iterator[tuple[tuple[int, int, int], tuple[int, int]]]:
    """Where enough seeds of an item meet in a text: (text, item, first diagonal) and (last diagonal, number of seeds)."""
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    i = np.arange(len(text))
    j = i + least[item] - 1
    to = np.minimum(j, len(text) - 1)
    met = (j == to) & (text[to] == text) & (item[to] == item)
    met &= start[to] - start <= spread[item]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, i[met], 1)
    np.add.at(edge, j[met] + 1, -1)
    live = np.cumsum(edge[:-1]) > 0
    text, item, start = text[live], item[live], start[live]
    apart = np.ones(len(text), bool)
    apart[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > spread[item[1:]])
    heads = np.flatnonzero(apart)
    tails = np.append(heads[1:], len(text))
    for a, b in zip(heads, tails):
        yield (int(text[a]), int(item[a]), int(start[a])), (int(start[b - 1]), int(b - a))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    bad = materialise(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(hinted(bad), docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
