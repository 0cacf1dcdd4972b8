"""UTF-8 bytes of Arrow text columns: slices, rolling hashes, words.

Everything works on whole batches: one byte buffer and the offsets of its texts. Memory follows ``SLICE_BYTES`` or the longest
text, whichever is larger. Hashes are 64 bit, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one-to-one)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: A random-looking value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

#: Space and the five ASCII controls that part words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower case for A to Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` (or its inverse) for i below ``n``, modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1024), _INVERSE if inverse else _BASE, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and ``n + 1`` offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows that hold about ``limit`` bytes, one row at least."""
    buf, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """``H`` with ``H[e] - H[s]`` the hash of values s to e, shifted by ``base ** s``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of spans, the same wherever a span stands. The length counts too."""
    inverse = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of all windows of a fixed size, by start."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[size:] - prefix[:n]) * powers(n, inverse=True))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without separators, within one text), and each text's first word."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A to Z in lower case, and each text's first word."""
    start, end, first = words(buf, off)
    prefix = prefix_hashes(BYTE_VALUES[LOWER[buf]])
    return span_hashes(prefix, start, end), first


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words, by first word, texts not regarded."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x2545F4914F6CDD1D) + mix(hashes[i:i + n] + np.uint64(i + 1))
    return mix(total)


def owners(first: np.ndarray) -> np.ndarray:
    """For items dealt to texts by their first item: the text of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
