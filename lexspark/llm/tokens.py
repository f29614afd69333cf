"""Word and n-gram hashing of whole Arrow string columns with numpy, no Python per word.

Bytes get a polynomial hash modulo 2**64 by prefix sums, so the hash of any run of
bytes costs two lookups. Words are runs of bytes above 0x20; they never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
#: What a byte adds to a hash, as it is and in lower case.
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_FOLD = _PLAIN.copy()
_FOLD[65:91] += np.uint64(32)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""

    def series(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0], have = 1, 1
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
        return out

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit hashes."""
    h = h + np.uint64((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array, and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and len(buf) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Hashed:
    """Prefix hashes over the folded (lower-case ASCII) bytes of the rows of a column."""

    def __init__(self, column: pa.Array, fold: bool = True):
        self.data, self.offsets = flat(column)
        n = len(self.data)
        self.pow, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        view = (_FOLD if fold else _PLAIN)[self.data]
        view *= self.pow[:n]
        np.cumsum(view, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the byte runs [start, end)."""
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words before each row (one more)."""
        ink = self.data > 32
        cuts = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        first[cuts] = ink[cuts]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        tails = cuts[cuts > 0] - 1
        last[tails] = ink[tails]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.offsets)
