"""Hashed shingle sets and one-permutation signatures, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def multiplier(i: int) -> np.uint64:
    return _ODD[i] if i < len(_ODD) else U64((int(_ODD[i % len(_ODD)]) * (2 * i + 1)) % (1 << 64) | 1)


class Words(dict):
    """64-bit hashes of words; a bounded memo."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text. Words are maximal runs of bytes
    other than ASCII white space, A-Z lower-cased; fewer words than size make one shingle."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, dtype=U64)
    h = np.fromiter(map(words.__getitem__, parts), dtype=U64, count=n)
    if n < size:
        out = np.array([sum(int(x) * int(multiplier(j)) for j, x in enumerate(h)) + n * 0x632BE59BD9B4E019 & (1 << 64) - 1], dtype=U64)
    else:
        out = h[: n - size + 1] * multiplier(0)
        for j in range(1, size):
            out = out + h[j : n - size + 1 + j] * multiplier(j)
    return np.unique(mix(out))


class OnePermutation:
    """One-permutation hashing with optimal densification.

    The hash range is cut into bins and a set's smallest hash in each is its value there. An
    empty bin borrows from the first filled bin in an order of its own (a random permutation
    that depends on the bin alone), which keeps the chance of agreement at the similarity.
    """

    def __init__(self, bins: int):
        self.bins = bins
        rng = np.random.default_rng(20240607)
        self.probe = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
        self.edges = np.array([(i << 64) // bins for i in range(bins)], dtype=U64)

    def __call__(self, ordered: np.ndarray) -> np.ndarray:
        """Values of a non-empty ascending array of distinct hashes."""
        at = np.searchsorted(ordered, self.edges)
        filled = at < np.append(at[1:], len(ordered))
        values = ordered[np.minimum(at, len(ordered) - 1)]
        if not filled.all():
            empty = np.flatnonzero(~filled)
            probes = self.probe[empty]
            values[empty] = values[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
        return values


def band_hashes(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of so many rows; bands never share a hash by design."""
    parts = mix(values).reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=U64) * U64(0x632BE59BD9B4E019)
    for j in range(rows):
        out = mix(out + parts[:, j] * multiplier(j))
    return out


def short(values: np.ndarray) -> np.ndarray:
    """16 bits of each value, enough to estimate likeness."""
    return (mix(values) >> U64(48)).astype("<u2")
