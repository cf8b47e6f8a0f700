"""Sets of 64-bit keys as bitmaps of bounded size, and counts by key in tables of bounded size.

A bitmap tells for sure that a key is not in the set. Where it says yes, the key is in the set
or shares its place with one that is, so what it lets through has to be decided exactly later.
The lowest two bits of a key do not choose its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of keys: 16 for a key, from MIN_BITS to MAX_BITS (16 MB).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap over the keys of a table; its size grows with the table up to MAX_BITS."""
    bits = MIN_BITS
    wanted = min(MAX_BITS, 16 * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.col("key").bitwiseAND(F.lit((bits - 1) << 2))
    word = F.shiftright(place, 8).alias("word")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(place, 2).bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(word, one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)  # at most MAX_BITS / 64 rows came
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def held_in(bitmaps: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether a key is in one of the bitmaps (or looks as if it were)."""
    out = np.zeros(len(keys), bool)
    for words in bitmaps:
        place = (keys >> np.uint64(2)) & np.uint64(64 * len(words) - 1)
        out |= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


class Counts:
    """Counts by key, added up in a table of bounded size."""

    def __init__(self, limit: int):
        self.limit, self.rows = limit, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.rows += len(keys)
        if self.rows > self.limit // 4:
            self.settle()

    def settle(self) -> None:
        """Known keys are counted where they stand, so little more than the table itself is held."""
        if not self.new:
            return
        keys = np.concatenate(self.new)
        self.new, self.rows = [], 0
        keys, counts = np.unique(keys, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        self.counts[place[known]] += counts[known]
        if not known.all():
            place, keys, counts = place[~known], keys[~known], counts[~known]
            self.keys, self.counts = np.insert(self.keys, place, keys), np.insert(self.counts, place, counts)

    def full(self) -> bool:
        return len(self.keys) >= self.limit

    def take(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for k in range(0, len(self.keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[k:k + 100_000].view(np.int64)),
                                              pa.array(self.counts[k:k + 100_000])], names=["key", "n"])
        self.keys, self.counts = self.keys[:0], self.counts[:0]
