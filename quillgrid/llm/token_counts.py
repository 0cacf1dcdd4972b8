"""Edit-aware token counts: a segment tree over each document's pre-token pieces.

The leaves are runs of ``LEAF`` pieces (white space and the characters after it) with their bytes and token counts; inner nodes hold sums.
An edit splices characters. Only the leaves it touches, and one more piece on either side as context, are encoded again, and the sums on
their paths to the root renewed. White space that BPE may join across pieces (other than ASCII) makes a document one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import bpe
from quillgrid.llm import textbytes as T

LEAF = 8


class Tree:
    """Leaves of a text with token counts, summed in a binary tree.

    ``texts`` are the leaves' bytes in order; ``sums[0]`` their counts, each further level the sums of pairs, the last one number.
    ``chars`` is the like for code points, which finds the leaves of an edit from the root down.
    """

    def __init__(self, texts: list[bytes], counts, chars, vocabulary: str = bpe.VOCABULARY):
        self.vocabulary = vocabulary
        self.texts = texts
        self.sums = self._levels(counts)
        self.chars = self._levels(chars)
        self.encoded = 0

    @staticmethod
    def _levels(values) -> list[np.ndarray]:
        levels = [np.asarray(values, np.int64)]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append(np.add.reduceat(x, np.arange(0, len(x), 2)))
        return levels

    @property
    def tokens(self) -> int:
        return int(self.sums[-1].sum())

    @property
    def length(self) -> int:
        return int(self.chars[-1].sum())

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last for the text's end), and the characters before the leaf."""
        node, before = 0, 0
        for level in reversed(self.chars[:-1]):
            node *= 2
            if node + 1 < len(level) and at - before >= level[node]:
                before += int(level[node])
                node += 1
        return node, before

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from ``start`` to ``end`` (clipped to the text)."""
        start = min(max(0, start), self.length)
        end = min(max(start, end), self.length)
        if not self.texts:
            self._splice(0, 0, text)
            return
        lo, before = self.find(start)
        hi, _ = self.find(end)
        # A piece may grow into its neighbour, so a leaf on either side is read too.
        if lo:
            lo -= 1
            before -= int(self.chars[0][lo])
        hi = min(hi + 2, len(self.texts))
        old = b"".join(self.texts[lo:hi]).decode()
        self._splice(lo, hi, old[:start - before] + text + old[end - before:])

    def _splice(self, lo: int, hi: int, text: str) -> None:
        texts, counts, chars = leaves_of(text, self.vocabulary)
        self.encoded += len(text)
        same = len(texts) == hi - lo
        self.texts[lo:hi] = texts
        if same:  # sums change on the paths above alone
            for levels, new in ((self.sums, counts), (self.chars, chars)):
                levels[0][lo:hi] = new
                a, b = lo, hi
                for below, level in zip(levels, levels[1:]):
                    a, b = a // 2, (b + 1) // 2
                    level[a:b] = np.add.reduceat(below[2 * a:2 * b], np.arange(0, len(below[2 * a:2 * b]), 2))
        else:
            self.sums = self._levels(np.concatenate([self.sums[0][:lo], counts, self.sums[0][hi:]]))
            self.chars = self._levels(np.concatenate([self.chars[0][:lo], chars, self.chars[0][hi:]]))

    def text(self) -> str:
        return b"".join(self.texts).decode()


def char_counts(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Code points between byte positions that part characters."""
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.diff(heads[edges])


def leaves_of(text: str, vocabulary: str = bpe.VOCABULARY) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Leaves of a text: bytes, tokens, characters."""
    raw = text.encode()
    if not raw:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(raw, np.uint8)
    whole = bpe._OTHER_SPACE.search(text)
    edges = np.array([0, len(raw)]) if whole else np.append(bpe.piece_starts(buf, np.array([0, len(raw)]))[::LEAF], len(raw))
    parts = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    enc = bpe.encoder(vocabulary)
    return parts, np.array([len(enc.encode_ordinary(p.decode())) for p in parts], np.int64), char_counts(buf, edges)


def trees(buf: np.ndarray, off: np.ndarray, vocabulary: str = bpe.VOCABULARY) -> list[Tree]:
    """The trees of all texts of a slice; distinct pieces are encoded once."""
    raw = buf.tobytes()
    out = []
    start = bpe.piece_starts(buf, off)
    bounds = np.searchsorted(start, off)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    plain = not bpe._OTHER_SPACE.search(raw.decode())
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        if b > a and not plain and bpe._OTHER_SPACE.search(raw[a:b].decode()):
            edges = np.array([a, b])
        else:
            edges = np.append(start[bounds[i]:bounds[i + 1]:LEAF], b) if b > a else np.array([b])
        cut = edges.tolist()
        parts = [raw[x:y] for x, y in zip(cut, cut[1:])]
        out.append(Tree(parts, np.zeros(len(parts), np.int64), np.diff(heads[edges]), vocabulary))
    # Counts of all leaves at once, so that a piece that occurs often is encoded once.
    leaf_texts = [p for t in out for p in t.texts]
    if leaf_texts:
        joined = np.frombuffer(b"".join(leaf_texts), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in leaf_texts])])
        _, begin = bpe.encode(joined, edges, vocabulary)
        counts, at = np.diff(begin), 0
        for t in out:
            n = len(t.texts)
            t.sums = Tree._levels(counts[at:at + n])
            at += n
    return out


def counts(docs: DataFrame, edits: str = "edits", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars, edited_sha256`` of each row.

    ``docs`` has ``doc_id``, ``text`` and an array of structs ``start, stop, put`` whose edits are applied in turn; positions count
    code points in the text as it then is, and are clipped to it. Null texts count as empty, null or no edits leave the text as it is,
    and null fields of an edit count as 0, as its start, and as the empty text. Repeated rows are counted each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in T.slices(batch.column(1), bpe.SLICE_BYTES):
                rows = []
                for tree, todo in zip(trees(buf, off, vocabulary), batch.column(2)[lo:hi].to_pylist()):
                    before = tree.length, tree.tokens
                    for e in todo or ():
                        start = e["start"] or 0
                        tree.edit(start, start if e["stop"] is None else e["stop"], e["put"] or "")
                    rows.append((*before, tree.length, tree.tokens, tree.encoded, hashlib.sha256(b"".join(tree.texts)).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5])],
                    ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars", "edited_sha256"])

    one = "struct<start:long,stop:long,put:string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(edits).cast(f"array<{one}>")).mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long, edited_sha256 string")


def sample_edits(text, doc_id):
    """Three edits that any document gets from its own text: a passage moved to another place, a deletion, and a word put in."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = F.pmod(F.xxhash64(doc_id), F.greatest(n, F.lit(1)).cast("long"))
    size = F.least(n, F.lit(60))
    return F.array(
        F.struct(at.alias("start"), (at + 20).alias("stop"), F.substring(text, 1, 40).alias("put")),
        F.struct((n / 2).cast("long").alias("start"), ((n / 2).cast("long") + size).alias("stop"), F.lit("").alias("put")),
        F.struct((n / 3).cast("long").alias("start"), (n / 3).cast("long").alias("stop"), F.lit(" revised ").alias("put")),
    )
