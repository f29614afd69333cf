"""Columns of integers as one binary value: few rows, and bytes that compress."""

from __future__ import annotations

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Equally long 64-bit columns. Each is kept above its least value, in as many bytes
    as it needs, first bytes together, then second ones."""
    n = len(columns[0])
    out = [np.int64(n).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        c = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)
        least = int(c.min()) if n else 0
        most = (int(c.max()) - least) if n else 0
        width = max(1, (most.bit_length() + 7) // 8)
        above = (c.view(np.uint64) - np.uint64(least & (2**64 - 1))).view(np.uint8).reshape(n, 8)
        out += [np.array([least, width], np.int64).tobytes(), np.ascontiguousarray(above[:, :width].T).tobytes()]
    return b"".join(out)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8, []
    for _ in range(columns):
        least, width = (int(x) for x in np.frombuffer(blob, np.int64, 2, at))
        at += 16
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out.append((wide.view(np.uint64).ravel() + np.uint64(least & (2**64 - 1))).view(np.int64))
    return out


def unpack_all(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of several values, one after the other; nulls and empty ones are skipped."""
    parts = [unpack(b, columns) for b in blobs if b]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(columns)]


def split(target: np.ndarray, *columns: np.ndarray):
    """(target, columns) of each distinct target, in order."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    t = target[order]
    cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(t)], strict=True):
        yield int(t[a]), [c[order[a:b]] for c in columns]
