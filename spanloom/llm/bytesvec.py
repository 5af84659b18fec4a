"""Words of whole Arrow batches, found and hashed by numpy over the UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, underscores and bytes of non-ASCII
characters. Case is not folded here; lower() the column beforehand where that is wanted.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WORD[95] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    p[1:] = np.uint64(0x100000001B3)
    return np.multiply.accumulate(p)


_POW = _powers(4096)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document number) of each word; words don't cross documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    flag = np.zeros(n + 2, np.int8)
    flag[1:-1] = _WORD[data]
    d = np.diff(flag)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[_WORD[data[cut]] & _WORD[data[cut - 1]]] if len(cut) else cut
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    longest = int(lens.max())
    powers = _POW if longest <= len(_POW) else _powers(longest)
    total = int(lens.sum())
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    inside = np.arange(total) - np.repeat(first, lens)
    at = inside + np.repeat(starts, lens)
    v = _TABLE[data[at]] * powers[inside]
    h = np.add.reduceat(v, first)
    return mix(h ^ (lens.astype(np.uint64) * _PRIME))


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each n-gram of words; a document of fewer words is one gram of all of them."""
    counts = np.bincount(doc, minlength=n_docs)
    if n == 1:
        return mix(h), doc
    if len(h) >= n:
        m = len(h) - n + 1
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g = mix(g * np.uint64(0x100000001B3) + h[k : k + m] + np.uint64(k + 1))
        whole = doc[:m] == doc[n - 1 :]
        g, gd = g[whole], doc[:m][whole]
    else:
        g, gd = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[short]
        k = counts[short]
        s = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            on = k > j
            s[on] = mix(s[on] * np.uint64(0x100000001B3) + h[first[on] + j] + np.uint64(j + 1))
        g, gd = np.concatenate([g, mix(s + k.astype(np.uint64) * _PRIME)]), np.concatenate([gd, short])
    return g, gd
