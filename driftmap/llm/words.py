"""Vectorised word tools for Arrow batches inside Spark tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Every function works on the
UTF-8 bytes of a slice of a batch, so the memory of a task follows SLICE_BYTES and its
longest document, not the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Documents are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: A random 64-bit value for each byte, as it is and with A-Z lower-cased.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]

_powers = np.ones(1, _U), np.ones(1, _U)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and its inverse's."""
    global _powers
    if len(_powers[0]) <= n:
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(n + 1 + n // 4, b, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = tuple(made)
    return _powers


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start:end]; equal runs have equal hashes wherever they stand."""
    p, q = _power(len(values))
    c = np.zeros(len(values) + 1, _U)
    np.cumsum(values * p[: len(values)], out=c[1:])
    return mix((c[end] - c[start]) * q[start] + (end - start).astype(_U))


class Words(NamedTuple):
    """A slice of documents: its bytes, document bounds in bytes, and its words."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
        return run_hash(values[self.data], self.start, self.end)

    def text(self, i: int) -> str:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes().decode("utf-8", "replace")


def _runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that no document bound may cross."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    opens[inner] = mask[inner]
    closes[inner - 1] = mask[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row bounds from 0) of each slice."""
    if not len(column):
        return
    data, bounds = as_bytes(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def split(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = ~SPACE) -> Words:
    """The words of a slice: runs of the bytes for which inside holds."""
    start, end = _runs(inside[data], bounds)
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, doc, first)


def batches(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, bounds in slices(column, limit):
        yield lo, hi, split(data, bounds)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all runs of k consecutive words of one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    h = np.full(len(at), _U(k))
    for j in range(k):
        h = h * _BASE + hashes[at + j]
    return at, mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each start and length, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    step = np.ones(total, np.int64)
    some = lengths > 0
    s, n = starts[some].astype(np.int64), lengths[some].astype(np.int64)
    step[0] = s[0]
    ends = np.cumsum(n)[:-1]
    step[ends] = s[1:] - (s[:-1] + n[:-1] - 1)
    return values[np.cumsum(step)]


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
