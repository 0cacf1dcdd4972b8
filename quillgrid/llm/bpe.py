"""Token ids of a public byte-level BPE vocabulary, for whole Arrow columns.

A pre-token of this vocabulary never runs from a character into following white space. So a text is cut where white space begins, each
distinct piece of a batch is encoded once, and ids are put together from the pieces. The pieces are encoded by the rank form of the
vocabulary, which gives the ids of the ``.json`` form (a test compares them). Texts holding other than ASCII white space, where pieces may
depend on their surroundings, are encoded whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from quillgrid.llm import textbytes as T

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
_NEWLINE = 198
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of this process. ``vocabulary`` names a file of the public tokenizers, or is a path."""
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken

        path = (vocabulary if "/" in vocabulary else P.path(vocabulary)).removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def encode_whole(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of one text, special tokens' strings being ordinary text."""
    return np.array(encoder(vocabulary).encode_ordinary(text), np.uint32)


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: at a text's start and at white space after another character."""
    n = len(buf)
    space = T.SEPARATOR[buf]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = space[1:] & ~space[:-1]
    cut[off] = True
    cut[n] = False
    return np.flatnonzero(cut)


def encode_pieces(pieces: list[bytes], vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces in some order; where each piece's ids begin, and how many it has."""
    enc = encoder(vocabulary)
    # In a joined text each line end is one token of its own, as these pieces hold no white space after their first character.
    plain = [i for i, p in enumerate(pieces) if p[0] > 32 or p[0] == 32 and p[1:2] > b" "]
    begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    ids, total = [np.zeros(0, np.uint32)], 0

    def put(where, part: np.ndarray, sizes: np.ndarray) -> None:
        nonlocal total
        begin[where], size[where] = total + np.cumsum(sizes) - sizes, sizes
        ids.append(part)
        total += len(part)

    rest = set(range(len(pieces))).difference(plain) if len(plain) < len(pieces) else set()
    for lo in range(0, len(plain), 20_000):
        some = plain[lo:lo + 20_000]
        joined = np.array(enc.encode_ordinary(b"\n".join([pieces[i] for i in some]).decode()), np.uint32)
        ends = np.flatnonzero(joined == _NEWLINE)
        if len(ends) == len(some) - 1:
            put(some, joined[joined != _NEWLINE], np.diff(np.concatenate([[-1], ends, [len(joined)]])) - 1)
        else:
            rest.update(some)
    for i in sorted(rest):
        part = np.array(enc.encode_ordinary(pieces[i].decode()), np.uint32)
        put([i], part, np.array([len(part)]))
    return np.concatenate(ids), begin, size


class Known:
    """The ids of pieces met so far by this process, by a 64-bit hash; forgotten when there are too many."""

    def __init__(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Sorted new keys with their ids."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, begin + len(self.ids))
        self.size = np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])


#: Pieces kept by a process (some 50 MB).
MOST_KNOWN = 1_000_000
#: Slices that share a sweep over the known pieces.
SLICE_BYTES = 1 << 20
_known: dict[str, Known] = {}


def piece_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, a part of the bytes at a time: hashing holds some forty times what it works on."""
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + T.SLICE_BYTES, "right")))
        a, b = start[lo], end[hi - 1]
        out[lo:hi] = T.span_hashes(T.prefix_hashes(T.BYTE_VALUES[buf[a:b]]), start[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    return out


def encode(buf: np.ndarray, off: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, and where each text's ids begin (one more at the end)."""
    known = _known.get(vocabulary)
    if known is None or len(known.keys) > MOST_KNOWN:
        known = _known[vocabulary] = Known()
    start = piece_starts(buf, off)
    end = np.append(start[1:], len(buf)) if len(start) else start
    key = piece_hashes(buf, start, end)
    u, at, back = np.unique(key, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    place = np.searchsorted(known.keys, u)
    new = np.ones(len(u), bool)
    inside = place < len(known.keys)
    new[inside] = known.keys[place[inside]] != u[inside]
    if new.any():
        some = at[new]
        known.add(u[new], *encode_pieces([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())], vocabulary))
        place = np.searchsorted(known.keys, u)
    size, begin = known.size[place][back], known.begin[place][back]
    total = np.concatenate([[0], np.cumsum(size)])
    out = known.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
    first = total[np.searchsorted(start, off)]
    if _OTHER_SPACE.search(raw.decode()):
        parts = [out[a:b] for a, b in zip(first[:-1], first[1:])]
        for i in range(len(parts)):
            one = raw[off[i]:off[i + 1]].decode()
            if _OTHER_SPACE.search(one):
                parts[i] = encode_whole(one, vocabulary)
        out = np.concatenate(parts)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return out, first
