"""Benchmark decontamination: Wu-Manber search for 13-word windows of benchmark items.

The search runs over word numbers instead of characters, so an occurrence always begins and
ends at a word. For the patterns of one length m there are three tables: the shift table
says for a block of two words how far the search may move on without missing a pattern, the
buckets list the patterns whose last block is the one at hand, and a direct comparison (of
word numbers, then of the words' bytes) confirms an occurrence.

The tables of a block of the benchmark are bounded by ``block_bytes`` of item text. A larger
benchmark is cut into several blocks by a hash of the item; each block is one more pass over
the texts within the same stage, without a shuffle.

Defined results. Texts: NULL, empty and wordless ones have no words and no hits. Items: NULL
or wordless texts have no windows; a NULL id is written as the empty string; repeated items
count once. Repeated document rows give repeated result rows. An empty benchmark hits
nothing. Further columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.textbatch import LOWER, WORD, Words, lists, mix, pieces, span_hashes

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Words that one search lane covers.
LANE = 512

_CHAIN = "doc_id bigint, text string, runs array<int>, items array<string>"
_DIGEST = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
           "contaminated boolean")


class Patterns:
    """Wu-Manber tables for patterns (rows of word numbers) of one length."""

    def __init__(self, rows: np.ndarray):
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        bits = max(10, int(len(rows) * self.m).bit_length() + 3)
        self.mask = np.int64((1 << bits) - 1)
        last = self._key(rows, self.m - 1)
        order = np.argsort(last, kind="stable")
        self.rows, self.row_of = rows[order], order
        self.bucket = np.searchsorted(last[order], np.arange(int(self.mask) + 2))
        self.shift = np.full(int(self.mask) + 1, self.m - self.block + 1, np.int32)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._key(rows, end), self.m - 1 - end)

    def _key(self, rows: np.ndarray, end: int) -> np.ndarray:
        value = rows[:, end].astype(np.uint64)
        if self.block == 2:
            value = value + rows[:, end - 1].astype(np.uint64) * np.uint64(0x9E3779B1)
        return (mix(value) & np.uint64(self.mask)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of occurrences and the rows of the patterns found there."""
        n, m = len(ids), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            value = ids[at].astype(np.uint64)
            if self.block == 2:
                value = value + ids[at - 1].astype(np.uint64) * np.uint64(0x9E3779B1)
            key = (mix(value) & np.uint64(self.mask)).astype(np.int64)
            step = self.shift[key]
            zero = step == 0
            if zero.any():
                found.append(np.stack([at[zero], key[zero]]))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, key = np.concatenate(found, axis=1)
        size = self.bucket[key + 1] - self.bucket[key]
        which = np.repeat(self.bucket[key] - np.cumsum(size) + size, size) + np.arange(size.sum())
        end = np.repeat(end, size)
        first = ids[end - m + 1] == self.rows[which, 0]
        end, which = end[first], which[first]
        for k in range(1, m):
            same = ids[end - m + 1 + k] == self.rows[which, k]
            end, which = end[same], which[same]
        return end, self.row_of[which]


class Benchmark:
    """The windows of one block of items: their words, tables and owners."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, text in zip(ids, texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(LOWER[raw], np.array([0, len(raw)]), WORD[LOWER[raw]])
            words = [w.data[b:e].tobytes() for b, e in zip(w.begin, w.end)]
            numbers = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words]
            length = min(window, len(numbers))
            for k in range(len(numbers) - length + 1 if numbers else 0):
                owners.setdefault(tuple(numbers[k:k + length]), set()).add("" if item is None else str(item))
        self.words = [b"", *vocabulary]
        self.tables, self.owners = [], []
        for length in sorted({len(k) for k in owners}):
            windows = [k for k in owners if len(k) == length]
            self.tables.append(Patterns(np.array(windows, np.int64)))
            self.owners.append([sorted(owners[k]) for k in windows])
        lengths = np.array([len(x) for x in self.words[1:]], np.int64)
        stops = np.cumsum(lengths)
        data = np.frombuffer(b"".join(self.words), np.uint8)
        value = span_hashes(data, stops - lengths, stops)
        order = np.argsort(value)
        self.hash, self.number = value[order], order + 1

    def numbers(self, words: Words) -> np.ndarray:
        """The number of every word; 0 for words that no item has."""
        if not len(self.hash):
            return np.zeros(len(words.begin), np.int64)
        value = words.hashes()
        at = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        return np.where(self.hash[at] == value, self.number[at], 0)

    def occurrences(self, words: Words, rows: int) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Hit word runs and hit items of every row."""
        runs: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        items: list[set[str]] = [set() for _ in range(rows)]
        ids = self.numbers(words)
        for table, owners in zip(self.tables, self.owners):
            end, row = table.search(ids)
            begin = end - table.m + 1
            doc = np.searchsorted(words.of, end, "right") - 1
            whole = begin >= words.of[doc]
            for b, d, r in zip(begin[whole].tolist(), doc[whole].tolist(), row[whole].tolist()):
                spans = zip(words.begin[b:b + table.m].tolist(), words.end[b:b + table.m].tolist())
                if all(words.data[s:e].tobytes() == self.words[n] for (s, e), n in zip(spans, ids[b:b + table.m])):
                    runs[d].append((b - int(words.of[d]), b - int(words.of[d]) + table.m))
                    items[d].update(owners[r])
        return runs, items


def _union(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def _passes(benchmark: Benchmark, first: bool, last: bool):
    """One pass of the chain: adds the hits of a block; the last one writes the digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for piece in pieces(text):
                part = batch.slice(piece.first, len(piece))
                words = piece.words(WORD, lower=True)
                runs, items = benchmark.occurrences(words, len(piece))
                if not first:
                    for k, old in enumerate(part.column("runs").to_pylist()):
                        runs[k] += list(zip(old[::2], old[1::2]))
                    for k, old in enumerate(part.column("items").to_pylist()):
                        items[k].update(old)
                runs = [_union(x) for x in runs]
                names = [sorted(x) for x in items]
                if not last:
                    flat = np.array([v for x in runs for v in x], np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("text"), lists(flat, offsets, pa.int32()),
                         pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "runs", "items"])
                    continue
                n_words = np.diff(words.of)
                n_hit = np.array([sum(x[1::2]) - sum(x[::2]) for x in runs], np.int64)
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit),
                     pa.array([len(x) for x in names], pa.int64()), pa.array(sha),
                     pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Benchmark]:
    """Search tables of the benchmark, each of about ``block_bytes`` of item text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    out = []
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).distinct().toArrow()
        out.append(Benchmark(part["item_id"].to_pylist(), part["text"].to_pylist()))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: words, words within windows of the benchmark, items found, verdict."""
    frame = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = blocks(benchmark, block_bytes)
    for k, table in enumerate(tables):
        last = k == len(tables) - 1
        frame = frame.mapInArrow(_passes(table, k == 0, last), _DIGEST if last else _CHAIN)
    return frame


def keep_clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, as they are, that the rule does not call contaminated.

    The rule needs nothing but the row's text, so rows are dropped where they are read.
    """
    tables = blocks(benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                words = piece.words(WORD, lower=True)
                hits: list[list[tuple[int, int]]] = [[] for _ in range(len(piece))]
                for table in tables:
                    for mine, found in zip(hits, table.occurrences(words, len(piece))[0]):
                        mine += found
                n_hit = np.array([sum(x[1::2]) - sum(x[::2]) for x in map(_union, hits)], np.int64)
                keep = ~((n_hit > 0) & (20 * n_hit >= np.diff(words.of)))
                yield batch.slice(piece.first, len(piece)).filter(pa.array(keep))
    return documents.mapInArrow(run, documents.schema)
