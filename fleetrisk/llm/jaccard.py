"""Exact n-gram Jaccard join with skipping by set relations, and its link components.

A document is the set of its word shingles. Equal sets form one class; everything below
works on classes. A class's shingles are put in a global order (rare ones first) and its
first few, the prefix, go to the shingles' index lists: two linked sets meet in a list.

* Index-level skipping. A list is kept in blocks by position, each sorted by set size.
  Position and size of an entry give, for every block, the range of sizes that can still
  link; blocks and entries outside the range are never touched.
  Entries that stay are looked at once more with parity bitmaps of the sets: the bits in
  which two bitmaps differ are a lower bound of the sets' difference.
* Answer-level skipping. Links only have to be known up to components. First every entry is
  compared with one pivot of its list (found in most common lists), then with its other
  pivots in other components. What is left is compared with whole components: the answers
  of the component's centre are computed once, and a member's overlap with a visiting set
  follows from the centre's overlap and the few shingles in which member and centre differ.
  A visit is skipped when the bound from these numbers excludes the component.
  Before whole texts move for a comparison, parity bitmaps that grow with the set (two to
  four bits a shingle) are moved and exclude what cannot link, however long the texts are.

No pairs are formed within a component, so a group of copies costs a row per member. Any
pair in different components that could link is decided exactly.

The shingle order comes from counters over all documents: a bucket of shingles that is far
above the mean goes to the end. The order only has to be the same everywhere, so the
counters' rounding costs time at most, never links.

Shingles are 64-bit hashes; a class is recognised by two 64-bit sums over its shingles.

Defined results. NULL, empty and blank texts are empty sets, linked with nothing. A
document of fewer words than a shingle is one shingle of all its words. Rows with a NULL
doc_id are nodes named by a hash of their text; the component's id is the smallest doc_id
that is not NULL, and NULL where there is none. Repeated rows give repeated result rows.
Rows that share a doc_id but not a text are documents of their own. A text of any length is
read whole; one text is in memory at a time, beside pieces of bounded size. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.components import merge
from fleetrisk.llm.textbatch import NOT_SPACE, lists, mix, pieces, window_hashes
from fleetrisk.llm.verify import (Family, _may, apart_pairs, classes_of, fold, free_name, linked, linked_pairs, pairs_in_reach,  # noqa: F401
                                  parity, shingles, text_nodes, visit_links, visits_in_reach, wide_bitmaps, with_nodes)

SHINGLE = 3
PERCENT = 90
#: Counters of the shingle order: a fixed number, 2 MB as levels.
COUNTERS = 1 << 21
#: Lists up to this length are compared entry by entry.
SHORT = 32
#: Entries of one list that a task searches; a longer list is cut into lists of two parts each.
LIST_ROWS = 2_000_000
#: Sets of more shingles get a second parity bitmap, which grows with the set.
WIDE_FROM = 256
#: Parity bitmap of a set, in 64-bit words (1024 bits).
BITS = tuple(f"b{k}" for k in range(16))


# ---------------------------------------------------------------- the order of shingles

def _counters(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                windows = window_hashes(piece.words(NOT_SPACE, lower=True).hashes(), shingle)
                counts += np.bincount((windows & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        often = np.flatnonzero(counts > max(8, 4 * counts.sum() // COUNTERS))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(often, pa.int64()), "n": pa.array(counts[often], pa.int64()),
            "total": pa.array(np.where(np.arange(len(often)) == 0, counts.sum(), 0), pa.int64())})
    return run


def order_levels(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """A level for every counter: 0 for rare shingles, more for ever more frequent ones."""
    rows = (texts.select("text").mapInArrow(_counters(shingle), "bucket bigint, n bigint, total bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow())
    levels = np.zeros(COUNTERS, np.uint8)
    if rows.num_rows:
        n = rows["n"].to_numpy()
        mean = max(1.0, rows["total"].to_numpy().sum() / COUNTERS)
        levels[rows["bucket"].to_numpy()] = np.maximum(0, np.floor(np.log2(n / mean)) - 1).astype(np.uint8)
    return levels


# ---------------------------------------------------------------- sets and index lists

def _sets(levels: np.ndarray, percent: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets = shingles(piece, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix(s ^ np.uint64(0x5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64)
                prefix = []
                for s in sets:
                    level = levels[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    if level.any():
                        s = s[np.lexsort((s, level))]
                    prefix.append(s[:len(s) - (percent * len(s) + 99) // 100 + 1] if len(s) else s)
                bits = np.zeros((len(sets), 64 * len(BITS)), np.uint8)
                for k, s in enumerate(sets):
                    bits[k] = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * len(BITS)), minlength=64 * len(BITS)) & 1
                bits = np.packbits(bits, axis=1).view(np.int64)
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("id"), pa.array(n), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), lists(flat.view(np.int64), offsets, pa.int64()),
                     *[pa.array(bits[:, k]) for k in range(len(BITS))]],
                    names=["doc_id", "id", "n", "a", "b", "prefix", *BITS])
    return run


class Lists:
    """Some complete index lists: entries sorted by shingle, position and size."""

    def __init__(self, shingle, pos, n, ids, percent: int, bits=()):
        self.shingle, self.pos, self.n, self.ids, self.percent = shingle, pos, n, ids, percent
        self.bits = np.stack(bits, axis=1).view(np.uint64) if len(bits) else None
        new = np.ones(len(shingle), bool)
        new[1:] = shingle[1:] != shingle[:-1]
        self.begin = np.flatnonzero(new)
        self.length = np.diff(np.append(self.begin, len(shingle)))
        self.own = np.repeat(np.arange(len(self.begin)), self.length)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of one list that may link, in chunks; each pair once."""
        for x, y in self._by_position():
            if self.bits is not None and len(x):
                apart = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64)
                ok = linked((self.n[x] + self.n[y] - apart) // 2, self.n[x], self.n[y], self.percent)
                x, y = x[ok], y[ok]
            yield x, y

    def _by_position(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        short = self.length[self.own] <= SHORT
        for d in range(1, SHORT):
            at = np.flatnonzero((self.own[d:] == self.own[:-d]) & short[d:]) if d < len(self.own) else []
            if not len(at):
                break
            ok = self._may_link(at, at + d)
            yield at[ok], at[ok] + d
        for k in np.flatnonzero(self.length > SHORT):
            yield from self._long(int(self.begin[k]), int(self.begin[k] + self.length[k]))

    def _may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(self.n[x] - self.pos[x], self.n[y] - self.pos[y])
        return linked(most, self.n[x], self.n[y], self.percent)

    def _long(self, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block: for each block the range of sizes that may link with each entry."""
        p = self.percent
        pos = self.pos[begin:end]
        starts = np.append(np.flatnonzero(np.append(True, pos[1:] != pos[:-1])), end - begin)
        for b, e in zip(starts[:-1], starts[1:]):
            x = np.arange(b, end - begin)  # this block and the later ones
            j = pos[b]
            nx, i = self.n[begin + x], pos[x]
            low = -((-(p * nx + (100 + p) * j)) // 100)
            high = (100 * nx - (100 + p) * i) // p
            live = low <= high
            x, low, high = x[live], low[live], high[live]
            if not len(x):
                continue
            sizes = self.n[begin + b:begin + e]
            lo = b + np.searchsorted(sizes, low, "left")
            hi = b + np.searchsorted(sizes, high, "right")
            hi = np.minimum(hi, x)  # within the block each pair once
            count = np.maximum(hi - lo, 0)
            cut = np.concatenate([[0], np.cumsum(count)])
            step = 0
            while step < len(x):  # about a million pairs at a time
                stop = max(step + 1, int(np.searchsorted(cut, cut[step] + 1_000_000, "right")) - 1)
                c = count[step:stop]
                y = np.repeat(lo[step:stop] - (cut[step:stop] - cut[step]), c) + np.arange(c.sum())
                yield begin + np.repeat(x[step:stop], c), begin + y
                step = stop


def _complete(batches: Iterator[pa.RecordBatch], names: list[str],
              limit: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Whole lists from sorted batches; with a limit, a list of more rows comes in parts, marked True."""
    held: list[list[np.ndarray]] = []
    rows, cut = 0, None  # cut: the list of which parts have been handed out
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += batch.num_rows
        if rows < min(100_000, limit or 100_000):
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        yield from _apart([c[:last] for c in columns], cut)
        held, rows = [[c[last:] for c in columns]], len(columns[0]) - last
        if limit and rows > limit:
            cut = columns[0][-1]
            yield held[0], True
            held, rows = [], 0
    if rows:
        yield from _apart([np.concatenate(c) for c in zip(*held)], cut)


def _apart(columns: list[np.ndarray], cut) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The rest of a list that has been handed out in parts, then the whole lists."""
    rest = int(np.searchsorted(columns[0], cut, "right")) if cut is not None else 0
    if rest:
        yield [c[:rest] for c in columns], True
    if rest < len(columns[0]):
        yield [c[rest:] for c in columns], False


def _candidates(percent: int, limit: int):
    """Entries that may link with another one of their list by position and size.

    A list beyond the limit is not searched here: all its entries go on, marked ``long``.
    """
    names = ["shingle", "pos", "n", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, part in _complete(batches, names, limit):
            some = np.full(len(columns[0]), part)
            if not part:
                for x, y in Lists(*columns, percent).pairs():
                    some[x] = some[y] = True
            yield pa.RecordBatch.from_arrays([*[pa.array(c[some]) for c in columns], pa.array(np.full(some.sum(), part))],
                                             names=[*names, "long"])
    return run


def _cut_long(near: DataFrame, limit: int) -> DataFrame:
    """Entries with every list beyond the limit replaced by lists of bounded length.

    A long list is cut into parts by id, and each two parts (and each part by itself) make a
    list of their own, so any two entries still meet.
    """
    sizes = near.where("long").groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"))
    sizes = settle(sizes.select("shingle", F.ceil(F.col("rows") * 4 / limit).cast("int").alias("parts")), "long")
    whole = near.where("not long").drop("long")
    if sizes.isEmpty():
        return whole
    cut = near.where("long").drop("long").join(sizes, "shingle")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    two = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    return whole.union(cut.withColumn("shingle", two).select(*whole.columns))


def _partners(percent: int):
    """Entries that may link with another entry of their list, each with a pivot to try first."""
    names = ["shingle", "pos", "n", "id", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in _complete(batches, names):
            entries = Lists(*columns[:4], percent, columns[4:])
            rows = len(columns[0])
            chance = mix(entries.ids.view(np.uint64) ^ entries.shingle.view(np.uint64))
            best, pivot = chance.copy(), np.arange(rows)
            some = np.zeros(rows, bool)
            for x, y in entries.pairs():
                some[x] = some[y] = True
                for mine, other in ((x, y), (y, x)):
                    np.minimum.at(best, mine, chance[other])
                    hit = best[mine] == chance[other]
                    pivot[mine[hit]] = other[hit]
            at = np.flatnonzero(some)
            ids, pivots = entries.ids[at], entries.ids[pivot[at]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[at]) for c in columns[:4]], pa.array(pivots, mask=pivots == ids)],
                names=[*names[:4], "pivot"])
    return run


def _visits(percent: int):
    """(id, comp) for every entry and every larger component it may link with in its list."""
    names = ["shingle", "pos", "n", "id", "comp", "members", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in _complete(batches, names):
            entries = Lists(*columns[:4], percent)
            comp, members = columns[4], columns[5]
            mixed = np.minimum.reduceat(comp, entries.begin) != np.maximum.reduceat(comp, entries.begin)
            keep = mixed[entries.own]
            if not keep.any():
                continue
            entries = Lists(*[c[keep] for c in columns[:4]], percent, [c[keep] for c in columns[6:]])
            comp, members = comp[keep], members[keep]
            for x, y in entries.pairs():
                other = comp[x] != comp[y]
                x, y = x[other], y[other]
                swap = (members[x] > members[y]) | ((members[x] == members[y]) & (comp[x] < comp[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                both = np.unique(np.stack([entries.ids[x], comp[y], members[y]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(3)], names=["id", "comp", "members"])
    return run


# ---------------------------------------------------------------- the operator

_SETS = ("doc_id bigint, id bigint, n bigint, a bigint, b bigint, prefix array<bigint>, "
         + ", ".join(f"{b} bigint" for b in BITS))
_ENTRY = "shingle bigint, pos bigint, n bigint, id bigint"


def _by_list(entries: DataFrame) -> DataFrame:
    return entries.repartition("shingle").sortWithinPartitions("shingle", "pos", "n", "id")


def _join(documents: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, id, n, a, b) of all documents and labels (id, comp) of linked classes."""
    nodes = text_nodes(documents)
    levels = order_levels(nodes, shingle)
    sets = settle(nodes.mapInArrow(_sets(levels, percent, shingle), _SETS), "sets")
    classes = sets.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("id", "prefix")).alias("first"))
    entries = classes.select("n", "first.id", F.posexplode("first.prefix").alias("pos", "shingle"))
    entries = entries.select("shingle", F.col("pos").cast("bigint").alias("pos"), "n", "id")
    near = settle(_by_list(entries).mapInArrow(_candidates(percent, LIST_ROWS), f"{_ENTRY}, long boolean"), "near")
    near = _cut_long(near, LIST_ROWS)
    near = near.join(sets.select("id", "n", *BITS).distinct(), ["id", "n"]).select("shingle", "pos", "n", "id", *BITS)
    shared = settle(_by_list(near).mapInArrow(_partners(percent), f"{_ENTRY}, pivot bigint"), "shared")

    ids = settle(shared.select("id").distinct(), "ids")
    looks = settle(sets.select("id", "n", *BITS).join(ids, "id", "left_semi").distinct(), "looks")
    texts = settle(nodes.join(ids, "id", "left_semi").select("id", "text").distinct(), "texts")
    labels = ids.select("id", F.col("id").alias("comp"))
    wide = settle(texts.mapInArrow(wide_bitmaps(shingle, WIDE_FROM), "id bigint, n bigint, wide binary"), "wide")
    pairs = shared.where("pivot is not null").groupBy("id", "pivot").count()
    pairs = settle(pairs_in_reach(pairs, wide, percent), "pairs")
    best = pairs.groupBy("id").agg(F.max(F.struct("count", "pivot"))["pivot"].alias("x"))
    labels = merge(labels, linked_pairs(best.select("x", F.col("id").alias("y")), texts, percent, shingle))
    rest = settle(apart_pairs(pairs.select(F.col("pivot").alias("x"), F.col("id").alias("y")), labels), "rest")
    if not rest.isEmpty():
        labels = merge(labels, linked_pairs(rest, texts, percent, shingle))
    votes = pairs.groupBy(F.col("pivot").alias("id")).agg(F.sum("count").alias("votes"))
    for largest in (True, False):
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
        named = shared.drop("pivot").join(labels, "id").join(sizes, "comp")
        # Only lists that hold several components go on, and only their entries get bitmaps.
        mixed = named.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        named = named.join(mixed.where("low <> high").select("shingle"), "shingle", "left_semi").join(looks, ["id", "n"])
        named = named.select("shingle", "pos", "n", "id", "comp", "members", *BITS)
        visits = _by_list(named).mapInArrow(_visits(percent), "id bigint, comp bigint, members bigint").distinct()
        if largest:
            visits = visits.groupBy("id").agg(F.max(F.struct("members", "comp")).alias("to")).select("id", "to.comp", "to.members")
        visits = settle(visits, "visits")
        if visits.isEmpty():
            break
        visits = settle(visits_in_reach(visits, labels, wide, percent), "visits")
        labels = merge(labels, visit_links(visits, labels, votes, texts, percent, shingle))
    return sets.select("doc_id", "id", "n", "a", "b"), labels


def near_copies(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: size of its set and the smallest doc_id that links reach."""
    sets, labels = _join(documents, percent, shingle)
    classes = classes_of(sets, labels).select("a", "b", F.col("n").alias("size"), "component_id")
    joined = sets.join(classes, [sets["a"] == classes["a"], sets["b"] == classes["b"], sets["n"] == classes["size"]], "left")
    mine = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def keep_one(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` with one row of each component: the smallest doc_id's.

    Rows with an empty set are all kept. Of repeated rows one stays. Different texts of one
    doc_id are judged each by itself. Other columns may have any name.
    """
    sets, labels = _join(documents, percent, shingle)
    classes = classes_of(sets, labels)
    rows = sets.where("n > 0").join(classes.select("a", "b", F.col("n").alias("size"), "comp"), ["a", "b"])
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"))
    node = free_name(documents, "node")
    keep = first.select(F.col("first.id").alias(node)).distinct()
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = with_nodes(documents.where(~blank), node).join(keep, node, "left_semi").dropDuplicates([node]).drop(node)
    return kept.unionByName(documents.where(blank))
