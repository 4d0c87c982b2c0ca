"""Distinct words of a chunk of texts and the hashed character n-grams in them."""

from __future__ import annotations

import numpy as np

from ._bytes import PrefixHash, hashes, mix, ranges

_ORDINARY = np.zeros(256, bool)
_ORDINARY[97:123] = True
_ORDINARY[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return low


def letter_words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of a-z and non-ASCII bytes, and the number of words before each row (one more than rows)."""
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _ORDINARY[low]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    start = start[start < n]
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return start, end, np.searchsorted(start, off)


def distinct(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, one occurrence of each, and which one each word is."""
    h = mix(hashes(low, start, end) ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(h, return_index=True, return_inverse=True)


def grams(low: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the n-grams of <word>, and with `whole` of the word itself."""
    n = end - start
    to = np.cumsum(n + 2) - (n + 2)
    text = np.full(int((n + 2).sum()), 60, np.uint8)
    text[ranges(to + 1, n)] = low[ranges(start, n)]
    text[to + n + 1] = 62
    p = PrefixHash(text)
    words, found = [], []
    if whole:
        words.append(np.arange(len(n)))
        found.append(p.of(to, to + n + 2) ^ np.uint64(0x5851F42D4C957F2D))
    for k in sizes:
        count = np.maximum(0, n + 3 - k)
        at = ranges(to, count)
        words.append(np.repeat(np.arange(len(n)), count))
        found.append(p.of(at, at + k) + np.uint64(k))
    return np.concatenate(words), (mix(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64)
