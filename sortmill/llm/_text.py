"""Vectorised views of Arrow string columns, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Gives memory that this worker has freed back to the machine: idle workers are kept, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers64(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and its n+1 offsets; a null is an empty run."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], offsets - first


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges (i, j) of at most `limit` bytes each, so that work arrays stay small; a row that is longer stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = max(i + 1, min(j, n))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes above 0x20 inside one row), and each row's first word as n+1 offsets."""
    if not len(raw):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = raw > 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge[1:] - 1] = inside[edge[1:] - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    pos = np.arange(int(length.sum()), dtype=np.int64)
    first = np.cumsum(length) - length
    pos -= np.repeat(first, length)
    at = pos + np.repeat(starts, length)
    term = (raw[at].astype(np.uint64) + np.uint64(1)) * powers64(base | 1, int(length.max()))[pos]
    return mix64(np.add.reduceat(term, first) + length.astype(np.uint64))
