"""Vectorised tokens: a text column's bytes become 64-bit word hashes with a handful of numpy passes, no Python call per word.

A word is a maximal run of ASCII letters, digits and bytes >= 0x80 (letters beyond ASCII); all other ASCII bytes separate words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_b = np.arange(256)
#: 1: letters and digits, 2: white space, 3: other ASCII
KIND = np.full(256, 3, np.uint8)
KIND[(_b >= 128) | ((_b >= 48) & (_b < 58)) | ((_b >= 65) & (_b < 91)) | ((_b >= 97) & (_b < 123))] = 1
KIND[[9, 10, 11, 12, 13, 32, 0]] = 2
UPPER = (_b >= 65) & (_b < 91)
DIGIT = (_b >= 48) & (_b < 58)

_rng = np.random.default_rng(20240601)
_CASED = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _CASED.copy()
_FOLDED[65:91] = _CASED[97:123]


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _INV)):
                a = np.full(n, base, U)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=U))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes, or one row that has more."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(raw: np.ndarray, off: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (and of the runs of other ASCII, if punctuation), and the n+1 word offsets of the rows. A row's end ends a word."""
    kind = KIND[raw]
    if punctuation:
        kind[kind == 2] = 0
    else:
        kind[kind != 1] = 0
    n = len(raw)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n]) if n > 1 else None
    edge[off] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    if n:
        full = kind[starts] > 0
        starts, ends = starts[full], ends[full]
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    up, down = _Powers.to(len(raw) + 1)
    c = np.empty(len(raw) + 1, U)
    c[0] = 0
    np.cumsum((_FOLDED if fold else _CASED)[raw] * up[: len(raw)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts])


def words(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of the rows: first row, last + 1, word hashes, offsets of the rows' words. ASCII letters are folded to lower case."""
    raw, off = buffers(texts)
    for i, j in pieces(off, most):
        r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, ptr = spans(r, o)
        yield i, j, hash_spans(r, s, e), ptr


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.zeros(1, np.int64), np.full(1, len(raw)))[0])


def rows_of(ptr: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def ngrams(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within rows, and their rows. A row of 1 to n-1 words has one gram of all its words; a row without words has none."""
    size, row = np.diff(ptr), rows_of(ptr)
    left = ptr[1:][row] - np.arange(len(h))  # words from here to the row's end
    start = left >= n
    short = (size > 0) & (size < n)
    first = ptr[:-1][short]
    start[first] = True
    at = np.flatnonzero(start)
    g = h[at] * U(0x9FB21C651E98DF25)
    for k in range(1, n):
        ok = left[at] > k
        nxt = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        g = np.where(ok, mix(g ^ (nxt + U(k))) * U(0x9FB21C651E98DF25), g)
    return mix(g), row[at]


class HashTable:
    """Ids of known hashes; looks up arrays. A bit table turns most unknown ones away before the binary search."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(keys))))) + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(keys >> U(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known hashes, and their ids."""
        at = np.flatnonzero(self.seen[(h >> U(64 - self.bits)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = h[at]
        k = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        ok = self.keys[k] == x
        return at[ok], self.order[k[ok]]
