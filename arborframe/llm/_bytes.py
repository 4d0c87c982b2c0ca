"""Array arithmetic on the bytes of text columns: chunks, words and prefix hashes, a few numpy passes per chunk instead of a Python step per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (their arrays of 64-bit numbers fit in a core's cache); a longer document is a chunk of its own.
CHUNK = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def frugal() -> None:
    """For a Python worker: arrays of 4 MB and more go back to the system when they are freed, rather than stay with a worker that waits for its next task."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; a fixed one, else glibc raises it up to 32 MB
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, text: str | None = None, most: int = 4 << 20):
    """A mapInArrow function whose worker gives its memory back at the end. If a column is named, batches come in parts of up to `most` bytes of it, or one longer row."""

    def parts(batches):
        for batch in batches:
            size = pc.fill_null(pc.binary_length(column(batch, text)), 0).cast(pa.int64())
            off = np.concatenate([[0], np.cumsum(np.asarray(size))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
                yield batch.slice(i, j - i)
                i = j

    def wrapped(batches):
        frugal()
        yield from run(parts(batches) if text else batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def lean_group(run):
    """The same for an applyInArrow function."""

    def wrapped(table):
        frugal()
        return run(table)

    return wrapped


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and where each row starts (one more than rows). Null: empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary() if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else pa.large_string())
    if text.null_count:
        text = text.fill_null("" if pa.types.is_large_string(text.type) else b"")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows that hold up to `most` bytes, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all others (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base % 2**64, 1 << max(19, int(n).bit_length()))[:n]


class PrefixHash:
    """Polynomial hashes (mod 2^64) of any byte range from one running sum."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        self.inverse = powers(pow(base, -1, 2**64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """PrefixHash.of for many ranges in ascending order, in runs of CHUNK bytes, so that a long text needs no more memory than a short one."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + CHUNK, "right")))
        out[i:j] = PrefixHash(data[a : int(end[j - 1])]).of(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ and, for each row, the number of words before it (one more than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    starts = starts[starts < n]
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, off)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0], and so on: the indices of many ranges."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(length) - length
    return np.repeat(start - at, length) + np.arange(total)
