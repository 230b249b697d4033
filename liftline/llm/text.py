"""Vectorised text work inside tasks: UTF-8 buffers of Arrow batches as numpy arrays.

Everything here handles one small slice of a batch at a time, so the memory of a task
does not depend on how many rows Spark puts into a batch. A single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C17)  # 3 modulo 4, so that powers differ in high bits
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Slice:
    """Texts ``first`` to ``first + n - 1`` of a batch: bytes and offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into runs of whole texts of about ``limit`` bytes."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the index of its first word."""
    if len(piece.data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(piece.n + 1, np.int64)
    gap = SPACE[piece.data]
    edge = np.zeros(len(gap) + 1, bool)
    edge[piece.offsets] = True
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, piece.offsets)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    power, inverse = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 2**64)))
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the finaliser of the public MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; A-Z count as a-z when ``fold``."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(max(20, int(len(data)).bit_length()))
    table = _BYTES[FOLD] if fold else _BYTES
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words per text, and per text the index of its first one.

    A text with fewer words has its whole sequence as one run, without words none.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    last = np.repeat(first[1:], runs)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        inside = at + j < last
        total += np.where(inside, padded[at + j] * _PLACES[j], _PLACES[k + j])
    return mix(total), begin


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges ``[start, start + length)`` of ``values``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
