"""Vectorised text kernels shared by the corpus operators.

Everything works on the raw UTF-8 bytes of an Arrow string column, a few MB at
a time, so a batch never needs Python work for each word.  Words are maximal
runs of bytes other than 0x20 and 0x09-0x0D; hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
FOLDED = EXACT.copy()
FOLDED[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of byte spans of one buffer by prefix sums (polynomial hash)."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * self.up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes; a longer row is a run of its own.

    A null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_FACTORS = mix(np.arange(1000, 1064, dtype=np.uint64)) | _U(1)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes, for every start that has n of them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += hashes[i : i + m] * _FACTORS[i]
    return mix(total + _U(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles): words fold A-Z; a shorter text has one shingle of all
    its words; a text without words, or null, has none."""
    for first, end, data, offsets in chunks(column):
        starts, ends, at = words(data, offsets)
        hashes = Spans(data, FOLDED).hash(starts, ends)
        grams = ngrams(hashes, n)
        for row in range(end - first):
            a, b = int(at[row]), int(at[row + 1])
            if b - a >= n:
                yield first + row, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield first + row, ngrams(hashes[a:b], b - a)
            else:
                yield first + row, np.zeros(0, np.uint64)
