"""Word boundaries and word hashes over Arrow string columns, about a megabyte at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a
longer character, so the search works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche (the public splitmix64 constants)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Words:
    """Words of consecutive rows: ``first[i]:first[i + 1]`` are those of row ``i``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=_U64)
        np.cumsum(_LETTER[self.data] * _powers(_BASE, n), out=sums[1:])
        spread = (sums[self.end] - sums[self.start]) * _powers(_BASE_INVERSE, n + 1)[self.start]
        return mix(spread + (self.end - self.start).astype(_U64))

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes with their bytes; a longer row stands alone."""
    raw, at = string_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words_of(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, offsets in slices(column):
        yield low, high, find_words(lowered(data) if lower else data, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window of ``width`` words that begins at each word (the last ones run short)."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=_U64)
    for k in range(width):
        out = out * _U64(0x9FB21C651E98DF25) + hashes[k : k + len(out)]
    return mix(out)
