"""Vectorised tokenising and hashing over UTF-8 bytes.  A word is a maximal run
of bytes above 0x20, so ASCII white space and control characters separate words."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_pows = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _pows
    if len(_pows) < n:
        p = np.full(max(n, 64), _P, np.uint64)
        p[0] = 1
        _pows = np.multiply.accumulate(p)
    return _pows


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; first[d] is the index of
    document d's first word, with the total as last entry."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ns = data > 32
    st, en = ns.copy(), ns.copy()
    st[1:] &= ~ns[:-1]
    en[:-1] &= ~ns[1:]
    edge = offs[(offs > 0) & (offs < n)]
    st[edge] = ns[edge]
    en[edge - 1] = ns[edge - 1]
    starts = np.flatnonzero(st)
    return starts, np.flatnonzero(en) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends) of all words."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    lens = ends - starts
    total = int(lens.sum())
    ws = np.cumsum(lens) - lens
    idx = np.arange(total) + np.repeat(starts - ws, lens)
    pos = np.arange(total) - np.repeat(ws, lens)
    v = powers(int(lens.max()) + 1)[pos] * (data[idx].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(v, ws)), first, starts, ends


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i that has n words after it in the array."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(g)


def doc_grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every n-gram inside one document."""
    g = gram_hashes(h, n)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(g):
        ok = doc[: len(g)] == doc[n - 1 : n - 1 + len(g)]
        return g[ok], doc[: len(g)][ok]
    return g, doc[:0]
