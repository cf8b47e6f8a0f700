"""Texts inside Spark tasks: Arrow string columns as byte arrays, words and hashes with numpy.

Spark hands a task its rows as Arrow batches. The helpers here cut a batch into pieces of
bounded size and see the texts of a piece as one array of UTF-8 bytes, so that words are
found and hashed for many documents in a few array operations. Every delimiter used is an
ASCII character, so cutting bytes cuts code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer document is a piece of its own.
PIECE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]`: everything but ASCII white space.
NOT_SPACE = ~SPACE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Lower case for A-Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for every byte, so that the rolling hash is not fooled by patterns.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length()) if n <= 4 * PIECE_BYTES else n
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if size <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


class Piece:
    """The texts of some rows: ``data`` holds their bytes, row i is data[starts[i]:starts[i+1]].

    A NULL text counts as no bytes; ``nulls`` tells it from an empty one.
    """

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray, nulls: np.ndarray):
        self.first, self.data, self.starts, self.nulls = first, data, starts, nulls

    def __len__(self) -> int:
        return len(self.starts) - 1

    def words(self, keep: np.ndarray, lower: bool = False) -> Words:
        data = LOWER[self.data] if lower else self.data
        return Words(data, self.starts, keep[data])


class Words:
    """Maximal runs of kept bytes; no run crosses from one row into the next.

    Word k is data[begin[k]:end[k]]; the words of row i are begin[of[i]:of[i+1]].
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, inside: np.ndarray):
        self.data = data
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[starts] = True
        cut = np.flatnonzero(edge)
        cut = cut[cut < n]
        kept = inside[cut] if n else np.zeros(0, bool)
        end = np.append(cut[1:], n)
        self.begin, self.end = cut[kept], end[kept]
        self.of = np.searchsorted(self.begin, starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return span_hashes(self.data, self.begin, self.end)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end], equal for equal bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(MULTIPLIER, n), out=total[1:])
    value = (total[end] - total[begin]) * powers(INVERSE, n + 1)[begin]
    return mix(value + (end - begin).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; one for each start that has n words."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(MULTIPLIER) + words[k:k + count]
    return mix(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
        wide = True
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, at


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Consecutive rows of a text column with at most ``limit`` bytes, one row at least."""
    raw, at = utf8(column)
    nulls = np.asarray(column.is_null())
    row, rows = 0, len(column)
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        stop = min(stop, rows)
        yield Piece(row, raw[at[row]:at[stop]], at[row:stop + 1] - at[row], nulls[row:stop])
        row = stop


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
