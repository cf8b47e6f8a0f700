"""Ranked lexical search by presence masks.

Items are the queries, all documents are ranked for each. A task turns its documents into
short posting lists of the items' terms; the bits of an item's terms over a document are its
presence mask. For every item:

* Documents are grouped by mask. A mask's highest possible score is the sum, over its terms,
  of the term's weight times its highest impact in the batch.
* Masks are taken by descending highest score, their documents are scored exactly, and the
  search stops when no later mask can reach the tenth score found so far. What a task found
  in earlier batches counts, so later batches stop early or are skipped whole.

Each task hands out at most ten documents an item; they are ranked among each other first in
buckets, then per item. Items go through in blocks of bounded size, each against all rows, so
neither the driver nor a task ever holds more than one block.

Terms are known by 64-bit hashes. Scores are whole numbers, exact in 64 bits.

Defined results. NULL, empty and termless texts have no terms: such documents are never found
and such items give no rows. Each row of ``items`` is an item by itself, each row of
``documents`` a document by itself: repeated rows give repeated rows with ranks of their own.
Equal scores go by ascending doc_id, NULL last. A text of any length is searched whole (one
document is in memory at a time, beside batches of bounded size). Empty tables give no rows.
Other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.textbatch import WORD, lists, pieces

TOP = 10
#: Item terms in one block of items, on average: 12 MB of arrays in each task.
BLOCK_TERMS = 1 << 20
#: Documents that are scored before the bound of the next mask is looked at.
CHUNK = 64
#: Buckets in which the tasks' findings are ranked first.
BUCKETS = 64

_LAST = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of every item and how often it holds them."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            w = piece.words(WORD, lower=True)
            hashes = w.hashes()
            per = [np.unique(hashes[b:e], return_counts=True) for b, e in zip(w.of[:-1], w.of[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in per])])
            terms, times = (np.concatenate([p[k] for p in per]) for k in (0, 1))
            part = batch.slice(piece.first, len(piece))
            yield pa.RecordBatch.from_arrays(
                [part.column("item"), lists(terms.view(np.int64), offsets, pa.int64()), lists(times, offsets, pa.int64())],
                names=["item", "terms", "times"])


def _postings(vocabulary: np.ndarray):
    """Documents that have terms: their number of terms, and the vocabulary's terms among them."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = piece.words(WORD, lower=True)
                hashes = w.hashes()
                n = np.diff(w.of)
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = vocabulary[at] == hashes
                row = np.repeat(np.arange(len(piece)), n)
                keys, times = np.unique(row[hit] * size + at[hit], return_counts=True)
                live = np.flatnonzero(n)
                offsets = np.append(np.searchsorted(keys, live * size), len(keys))
                ids = batch.column("doc_id").slice(piece.first, len(piece)).take(pa.array(live))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n[live], pa.int64()), lists(keys % size, offsets, pa.int32()),
                     lists(times, offsets, pa.int32())], names=["doc_id", "n", "terms", "times"])
    return run


def _document_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(counts[some])})
    return run


class Batch:
    """Some documents: postings by document, and by term with each term's highest impact."""

    def __init__(self, batch: pa.RecordBatch, documents: int, occurrences: int):
        terms, times = batch.column("terms"), batch.column("times")
        ids = batch.column("doc_id")
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.null = np.asarray(ids.is_null())
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        length = 25 + 75 * n * documents // occurrences
        per = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(per)])
        self.terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), per)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * length[row])
        order = np.argsort(self.terms, kind="stable")
        self.rows = row[order]
        by_term = self.terms[order]
        new = np.flatnonzero(np.append(True, by_term[1:] != by_term[:-1])) if len(order) else np.zeros(0, np.int64)
        self.known = by_term[new]
        self.lists = np.append(new, len(order))
        self.highest = np.maximum.reduceat(self.impact[order], new) if len(order) else self.impact

    def masks(self, at: np.ndarray) -> np.ndarray:
        """Bitmaps, a column for each document: bit k tells whether it has the k-th of the terms."""
        out = np.zeros((-(-len(at) // 64), len(self.ids)), np.uint64)
        for k, t in enumerate(at.tolist()):
            out[k // 64, self.rows[self.lists[t]:self.lists[t + 1]]] |= np.uint64(1) << np.uint64(k % 64)
        return out

    def scores(self, rows: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``gain`` holds weight times repeats for every term."""
        count = self.begin[rows + 1] - self.begin[rows]
        cut = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.begin[rows] - cut[:-1], count) + np.arange(cut[-1])
        total = np.concatenate([[0], np.cumsum(gain[self.terms[at]] * self.impact[at])])
        return total[cut[1:]] - total[cut[:-1]]


def _groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct non-empty masks (a row each), and the group of every document (-1: empty)."""
    live = np.flatnonzero(masks.any(axis=0))
    group = np.full(masks.shape[1], -1)
    if len(masks) == 1:
        distinct, group[live] = np.unique(masks[0, live], return_inverse=True)
        return distinct[:, None], group
    packed = np.ascontiguousarray(masks[:, live].T)
    distinct, inverse = np.unique(packed.view(np.dtype((np.void, 8 * len(masks)))).ravel(), return_inverse=True)
    group[live] = inverse
    return distinct.view(np.uint64).reshape(-1, len(masks)), group


class Best:
    """The best documents found for one item."""

    def __init__(self):
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self, top: int) -> int:
        """A document with a lower score is not wanted."""
        return int(self.scores[-1]) if len(self.scores) == top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, top: int) -> None:
        good = scores >= self.least(top)
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        null = np.append(self.null, null[good])
        order = np.lexsort((ids, null, -scores))[:top]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def _search(batch: Batch, terms: np.ndarray, gains: np.ndarray, gain: np.ndarray, best: Best, top: int) -> None:
    """Brings ``best`` of one item up to date with a batch."""
    at = np.minimum(np.searchsorted(batch.known, terms), max(len(batch.known) - 1, 0))
    here = batch.known[at] == terms if len(batch.known) else np.zeros(len(terms), bool)
    at, highest = at[here], gains[here] * batch.highest[at[here]]
    if highest.sum() < best.least(top):
        return
    distinct, group = _groups(batch.masks(at))
    bits = np.unpackbits(distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(at)]
    bound = bits @ highest
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bound = bound[order]
    # Documents by the place of their mask.
    rows = np.flatnonzero(group >= 0)
    key = place[group[rows]]
    rows = rows[np.argsort(key, kind="stable")]
    ends = np.cumsum(np.bincount(key, minlength=len(order)))
    mask = done = 0
    while mask < len(order) and bound[mask] >= best.least(top):
        # Whole masks up to about CHUNK documents.
        mask = max(mask, int(np.searchsorted(ends, done + CHUNK, "right")) - 1) + 1
        some = rows[done:ends[mask - 1]]
        best.add(batch.scores(some, gain), batch.ids[some], batch.null[some], top)
        done = int(ends[mask - 1])


def _rank(items: np.ndarray, offsets: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray,
          documents: int, occurrences: int, top: int):
    """The best documents of a task for every item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in items]
        gain = np.zeros(len(weights), np.int64)
        for arrow in batches:
            batch = Batch(arrow, documents, occurrences)
            for k, found in enumerate(best):
                mine = terms[offsets[k]:offsets[k + 1]]
                gain[mine] = gains = weights[mine] * times[offsets[k]:offsets[k + 1]]
                _search(batch, mine[gains > 0], gains[gains > 0], gain, found, top)
                gain[mine] = 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(items, [len(b.ids) for b in best])),
             pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.null for b in best])),
             pa.array(np.concatenate([b.scores for b in best]))], names=["item", "doc_id", "score"])
    return run


def _search_block(documents: DataFrame, block: pa.Table, top: int) -> DataFrame | None:
    """(item, doc_id, score) of the best documents each task has for the items of a block."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in block["terms"]])]).astype(np.int64)
    hashes = block["terms"].combine_chunks().flatten().to_numpy().view(np.uint64)
    times = block["times"].combine_chunks().flatten().to_numpy()
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    if not len(vocabulary):
        return None
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n bigint, terms array<int>, times array<int>"
    postings = settle(texts.mapInArrow(_postings(vocabulary), schema), "postings")
    count, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return None
    held = (postings.select("terms").mapInArrow(_document_counts(len(vocabulary)), "term bigint, df bigint")
            .groupBy("term").agg(F.sum("df").alias("df")).toArrow())  # at most the block's terms
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(held["term"].to_pylist(), held["df"].to_pylist()):
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
    run = _rank(block["item"].to_numpy(), offsets, terms, times, weights, count, total, top)
    return postings.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def rank_documents(documents: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score."""
    named = settle(items.select("item_id", F.col("text").cast("string").alias("text"),
                                F.monotonically_increasing_id().alias("item")), "items")
    known = settle(named.select("item", "text").mapInArrow(_item_terms, "item bigint, terms array<bigint>, times array<bigint>"),
                   "terms")
    total = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    found = []
    for k in range(blocks):
        # In tables of several blocks each block's findings are settled, and its arrays go, before the next.
        block = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        best = _search_block(documents, block, top)
        if best is not None:
            found.append(best if blocks == 1 else settle(best, "found"))
    if not found:
        return named.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"),
                                     F.lit(0).cast("bigint").alias("score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for group in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))], ["item"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= top)
    return rows.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
