"""Periodic runs of words: a sparse dynamic programme over diagonals.

The cell (word i, lag d) holds the number of equal words that end there on its diagonal: L(i, d) = L(i - 1, d) + 1 where word i equals word
i - d. A run of period q and length m is a diagonal q on which L reaches m - q and ends; runs of at least ``max(LEAST, TIMES * q)`` words
need L >= max(LEAST - q, 2 * q). Only cells that can count are made:

* Lags below 16 are compared for every word.
* For lags from G to 2G (G = 16, 32, ...) L passes 2G, so whole stretches of G words are equal. A word's earlier occurrences are those of
  the G words that begin there. Stretches that come again within G / 2 words have a period of G / 2 or less, and are left out: a run with
  smallest period q >= G holds, among any q + 1 starts in a row, one stretch without such a short period (else, by Fine and Wilf, the run
  itself had it). The others recur more than G / 2 apart, so each word starts at most three cells.

Cells of one diagonal with consecutive words extend one another; what is found is extended to both ends by search over prefix hashes, and
compared word by word. So a text of n words takes O(n log n) space and time, whatever it repeats. All texts of a slice are worked on at once,
parted by words that occur nowhere else. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import textbytes as T

LEAST = 24
TIMES = 3
_DENSE = 16


def equal_stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.zeros(len(same) + 2, np.int8)
    edge[1:-1] = same
    flips = np.flatnonzero(np.diff(edge))
    return flips[::2], flips[1::2]


def diagonal(words: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the runs on one diagonal whose L reaches ``least``."""
    if len(words) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = equal_stretches(words[lag:] == words[:-lag])
    long = end - start >= least
    return start[long], (end - start)[long] + lag


def seeds(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells ``(place, lag)``, lags from ``size`` to twice that, where the stretch at a place occurred before and has no short period."""
    n = len(grams)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    low = np.uint64((1 << int(n - 1).bit_length()) - 1)
    order = (np.sort((grams & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    value = grams[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = value[1:] == value[:-1]
    several = same[:n] | same[1:]
    if not several.any():
        return none, none
    place, new = order[several], ~same[:n][several]
    group = np.cumsum(new) - 1
    close = ~new
    close[1:] &= place[1:] - place[:-1] <= size // 2
    dense = np.zeros(group[-1] + 1, bool)
    dense[group[close]] = True
    keep = ~dense[group]
    place, group = place[keep], group[keep]
    at, lags = [none], [none]
    for back in (1, 2, 3):
        lag = place[back:] - place[:-back]
        good = (group[back:] == group[:-back]) & (lag >= size) & (lag < 2 * size)
        at.append(place[back:][good])
        lags.append(lag[good])
    return np.concatenate(at), np.concatenate(lags)


def equal_length(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many words from places a and b on (or before them) are equal, ``most`` at the most."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        if backward:
            same = T.span_hashes(prefix, a - middle, a) == T.span_hashes(prefix, b - middle, b)
        else:
            same = T.span_hashes(prefix, a, a + middle) == T.span_hashes(prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (numbered in its text), length and smallest period of all runs of ``least`` words and ``times`` (3 or more) periods.

    ``words`` are hashes, text k those from ``first[k]`` to ``first[k + 1]``. Sorted by text, first word and period.
    """
    texts = len(first) - 1
    size = np.diff(first)
    shift = np.arange(texts)
    # A word of its own ends each text.
    line = np.insert(words, first[1:], T.mix(shift.astype(np.uint64) + np.uint64(0x5EED0F0D0C0B0A09)))
    begin, end = first[:-1] + shift, first[1:] + shift
    longest = int(size.max(initial=0))
    found = []
    for lag in range(1, min(_DENSE - 1, longest // times) + 1):
        start, length = diagonal(line, lag, max(least - lag, (times - 1) * lag))
        found.append((start, length, np.full(len(start), lag)))
    width, grams, place = 1, line, np.arange(len(line))
    prefix = None
    while times * max(width, _DENSE) <= longest:
        if width >= _DENSE:
            at, lag = seeds(grams, width)
            at = place[at]
            if len(at):
                prefix = T.prefix_hashes(line) if prefix is None else prefix
                found.append(_extend(line, prefix, begin, end, at, lag, width, least, times))
        # Texts too short for the next lags are left out; each is in one piece with its end word.
        keep = size >= times * max(2 * width, _DENSE)
        part = np.repeat(keep, size + 1)[place]
        grams, place = grams[part], place[part]
        grams = T.mix(grams[:-width] * np.uint64(0x2545F4914F6CDD1D) + grams[width:])
        place = place[:len(grams)]
        width *= 2
    start, length, lag = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ([], [], [])))
    # Multiples of a period tell the same stretch: its smallest period stays.
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    order = np.lexsort((lag, start))
    start, length, lag = start[order], length[order], lag[order]
    text = np.searchsorted(begin, start, "right") - 1
    return text, start - begin[text], length, lag


def _extend(line, prefix, begin, end, at, lag, width, least, times):
    """The runs that cells belong to."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    head = np.ones(len(at), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    tail = np.append(head[1:], True)
    first, last, lag = at[head], at[tail] + width, lag[head]
    text = np.searchsorted(begin, first, "right") - 1
    before = equal_length(prefix, first, first - lag, np.maximum(first - lag - begin[text], 0), backward=True)
    after = equal_length(prefix, last, last - lag, np.maximum(end[text] - last, 0))
    start, match = first - lag - before, last - first + before + after
    good = (match >= np.maximum(least - lag, (times - 1) * lag)) & (start >= begin[text])
    out = np.unique(np.stack([start[good], match[good], lag[good], text[good]], 1), axis=0)
    rows = []
    for s, m, d, t in out.tolist():
        if np.array_equal(line[s:s + m], line[s + d:s + d + m]):
            rows.append((s, m + d, d))
        else:  # a prefix hash erred: read the text's diagonal
            a, n = diagonal(line[begin[t]:end[t]], d, max(least - d, (times - 1) * d))
            rows += [(x + int(begin[t]), y, d) for x, y in zip(a.tolist(), n.tolist())]
    rows = np.array(sorted(set(rows)), np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def repeat_words(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word of its text stands at each place, for the sample edit that makes one text of ten periodic (see ``collapse``)."""
    n = np.diff(first)
    place = np.arange(first[-1])
    for k, doc in enumerate(ids):
        h = zlib.crc32(b"" if doc is None else str(doc).encode())
        if h % 10 == 0 and n[k]:
            g = h // 10
            a = int(g % n[k])
            p = 1 + (int(n[k]) - a) // (3 + g % 8)
            own = place[first[k] + a:first[k + 1]]
            own[:] = first[k] + a + np.arange(len(own)) % p
    return place


_NO_RUNS = hashlib.sha256(b"").hexdigest()


def collapse(docs: DataFrame, sample_edit: bool = False, with_text: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` (and ``collapsed``) of each row of
    ``doc_id, text``.

    A run is a longest stretch of words with smallest period q and at least ``max(least, times * q)`` words. The four numbers tell the
    run of the greatest length by period. The collapsed text has no word that a run holds after its first period; words are joined by one
    space. With ``sample_edit``, words of a text whose id's crc32 h is a multiple of ten repeat with a period from a place on, both drawn
    from h. Null or empty texts have no words, a null id counts as the empty text in h. Repeated rows are told each, other columns are
    ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for lo, hi, buf, off in T.slices(batch.column(1)):
                rows = _told(doc[lo:hi], buf, off, sample_edit, with_text, least, times)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["collapsed"] * with_text
    kinds = [pa.int64()] * 6 + [pa.string()] * (2 + with_text)
    schema = ", ".join(f"{c} {'long' if k == pa.int64() else 'string'}" for c, k in zip(names, kinds))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _told(ids: list, buf: np.ndarray, off: np.ndarray, sample_edit: bool, with_text: bool, least: int, times: int) -> list[tuple]:
    start, end, first = T.words(buf, off)
    value = T.span_hashes(T.prefix_hashes(T.BYTE_VALUES[buf]), start, end)
    if sample_edit:
        place = repeat_words(ids, first)
        start, end, value = start[place], end[place], value[place]
    text, at, length, period = runs(value, first, least, times)
    # Words after a run's first period go.
    change = np.zeros(len(value) + 1, np.int32)
    where = first[text] + at
    np.add.at(change, where + period, 1)
    np.add.at(change, where + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    start, size = start[kept], (end - start)[kept] + 1
    stop = np.cumsum(size)
    spaced = np.append(buf, np.uint8(32))[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    spaced[stop - 1] = 32
    heads = np.concatenate([[0], np.cumsum(kept)])[first]
    bounds = np.concatenate([[0], stop])[heads].tolist()
    cut = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
    found = list(zip(at.tolist(), length.tolist(), period.tolist()))
    out = []
    for k, doc in enumerate(ids):
        data = spaced[bounds[k]:max(bounds[k], bounds[k + 1] - 1)].tobytes()
        own = found[cut[k]:cut[k + 1]]
        best: tuple = (None, None, None, None)
        for s, n, q in own:
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q, 1000 * n // q)
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest() if own else _NO_RUNS
        out.append((doc, len(own), *best, listed, hashlib.sha256(data).hexdigest(), *([data.decode()] if with_text else [])))
    return out
