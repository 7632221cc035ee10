"""Vectorised hashing of words: polynomial prefix hashes over the bytes of many texts at once.

A word's 64-bit hash is (P[end] - P[start]) * B^-start, mixed with its length, where P sums byte * B^i
modulo 2^64. So words, their prefixes and word n-grams of a whole batch are hashed without a Python loop.
"""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


class Words:
    """Tokens of a batch of texts. starts, ends: bytes; first[d]..first[d+1]: the tokens of text d.

    classes None: words are runs of bytes other than white space. Else a table byte -> class, 0 for white
    space; a token is a run of one class.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        kind = (~SPACE[data]).astype(np.uint8) if classes is None else classes[data]
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        edges = np.flatnonzero(begins)
        ends = np.append(edges[1:], n) if len(edges) else edges
        solid = kind[edges] > 0
        self.starts, self.ends = edges[solid], ends[solid]
        self.kinds = kind[self.starts]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        power, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash for each token, or of its first bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        h = (self._sums[ends] - self._sums[self.starts]) * self._inverse[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64))

    def texts(self) -> np.ndarray:
        """The text that each token is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens that stay in a text, and the text of each."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    texts = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[texts] + within
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return h, texts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of n-word shingles, as sorted distinct hashes and where each set begins.

    A text of fewer words has its whole sequence as the one shingle; one without words has the empty set.
    """
    words = Words(data, offsets)
    hashes = words.hashes()
    parts = [ngrams(hashes, words.first, n)]
    for k in range(1, n):
        if len(short := np.flatnonzero(words.counts == k)):
            h = np.full(len(short), k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[words.first[short] + j])
            parts.append((h, short))
    h, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, texts))
    h, texts = h[order], texts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (texts[1:] != texts[:-1])
    h, texts = h[new], texts[new]
    return h, np.searchsorted(texts, np.arange(len(offsets)))
