"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII characters;
ASCII and Latin-1 capitals are folded.  Words get 64-bit hashes that depend on
their bytes alone, computed for whole batches by prefix sums of a polynomial.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("i", _P_INV)):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(t)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if len(off) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


class Words:
    """``hashes`` of all words of a batch, ``off[d]:off[d+1]`` those of text d;
    ``start`` and ``end`` are their byte positions in ``data``."""

    def __init__(self, arr: pa.Array, chunk: int = 256 << 10):
        self.data, self.doc_off = utf8(arr)
        n = len(self.data)
        is_word = _WORD[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.doc_off] = True
        prev = np.empty(n, dtype=bool)
        if n:
            prev[0] = False
            prev[1:] = is_word[:-1]
        first = is_word & (~prev | edge[:-1])
        nxt = np.ones(n, dtype=bool)
        if n:
            nxt[:-1] = ~is_word[1:]
        last = is_word & (nxt | edge[1:])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, self.doc_off)
        self.hashes = np.empty(len(self.start), dtype=U64)
        folded = fold(self.data)
        a = 0
        while a < len(self.start):  # pieces that end between words keep the tables small
            base = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, base + chunk, side="right")))
            stop = self.end[b - 1]
            p, inv = _tables(int(stop - base) + 1)
            with np.errstate(over="ignore"):
                part = (folded[base:stop].astype(U64) + U64(1)) * p[: stop - base]
                acc = np.empty(stop - base + 1, dtype=U64)
                acc[0] = 0
                np.cumsum(part, out=acc[1:])
                s, e = self.start[a:b] - base, self.end[a:b] - base
                self.hashes[a:b] = mix((acc[e] - acc[s]) * inv[s])
            a = b

    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs and the offsets by text; a text of 1 to k-1
    words has one shingle of all its words, a text without words has none."""
    w, n = words.hashes, words.counts()
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(m)])
    total = int(off[-1])
    if total == 0:
        return np.empty(0, U64), off
    at = np.arange(total) + np.repeat(words.off[:-1] - off[:-1], m)
    stop = np.repeat(words.off[1:], m)
    h = np.zeros(total, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            idx = at + j
            ok = idx < stop
            term = w[np.minimum(idx, len(w) - 1)] + U64(j + 1)
            h = h * U64(0xD6E8FEB86659FD93) + np.where(ok, term, U64(0))
    return mix(h), off


def reduce_by(ufunc: np.ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` by segment, with ``empty`` for empty segments."""
    n = np.diff(off)
    out = np.full(len(n), empty, dtype=values.dtype)
    has = n > 0
    if has.any():
        out[has] = ufunc.reduceat(values, off[:-1][has])
    return out
