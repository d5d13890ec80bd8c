"""Vectorised word hashing over Arrow string columns, shared by the operators that look at words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All work is done on the UTF-8 buffer of a slice of
rows at once: prefix sums of ``T[byte] * P**i`` modulo 2**64 give each word's hash by one subtraction, and the same
trick over word hashes gives the hash of any run of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)])
        return self.up[:n], self.down[:n]


_WORD, _RUN_A, _RUN_B = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)


@dataclass
class Words:
    """The words of consecutive rows. ``row`` counts from the slice's first row; ``begin`` and ``end`` are byte offsets."""

    rows: int
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


#: ASCII apart from letters and digits, as word separators.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """Hash the words of the rows whose bytes lie at ``data[bounds[i]:bounds[i + 1]]`` (``bounds[0] == 0``)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(len(bounds) - 1, none, none, none, none.astype(np.uint64))
    is_word = ~separators[data]
    breaks = np.zeros(n + 1, bool)
    breaks[bounds] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | breaks[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | breaks[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _WORD.get(n)
    sums = np.cumsum((_LOWER if lower else _BYTES)[data] * up)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    hashed = mix((sums[end - 1] - before) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(len(bounds) - 1, np.searchsorted(bounds, begin, side="right") - 1, begin, end, hashed)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words that lies in one row, by position of its first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = w.hash[:n]
    for i in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + w.hash[i : i + n])
    inside = w.row[:n] == w.row[k - 1 :]
    return w.row[:n][inside], out[inside]


def runs(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the word runs ``hashes[begin:end]``; ``second`` gives an independent hash."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = (_RUN_B if second else _RUN_A).get(len(hashes) + 1)
    spread = mix(hashes ^ np.uint64(0xA24BAED4963EE407)) if second else hashes
    sums = np.r_[np.uint64(0), np.cumsum(spread * up[: len(hashes)])]
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column in slices of whole rows: first row, row after the last, bytes and bounds. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
