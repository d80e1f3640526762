"""Words of whole texts as numpy arrays.

Every counting operator of this package needs the words of a text and a
64-bit value for each.  Both come from one pass over the bytes of an Arrow
string column: a byte class table finds the words, and a polynomial hash by
prefix sums gives each word its value, without a Python object per word.

Words are told apart by 64-bit values.  Two different words of a corpus of
ten million words share a value with a chance of about 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this many bytes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeded(256, 7)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, and A-Z, which are lower-cased first
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Slice:
    """Rows lo to hi of a batch: their bytes one after another, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from slices(chunk, max_bytes)
        return
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


@dataclass
class Words:
    starts: np.ndarray  # byte at which each word begins
    ends: np.ndarray
    bounds: np.ndarray  # words before each row, and in all
    values: np.ndarray  # 64-bit value of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def span_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit value of the bytes of each span, independent of where it lies."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(s: Slice, word_bytes: np.ndarray = NOT_SPACE, fold: bool = True) -> Words:
    """The words of each row: maximal runs of word bytes."""
    inside = word_bytes[s.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = s.offsets[(s.offsets > 0) & (s.offsets < len(s.data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, s.offsets), span_values(s.data, starts, ends, fold))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of k words within a row: its first word, and a 64-bit value."""
    n = len(w.values)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n - k + 1, np.uint64)
    for j, c in enumerate(seeded(k, 11) | np.uint64(1)):
        value += w.values[j : n - k + 1 + j] * c
    rows = w.rows
    first = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
    return first, mix(value[first])


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
