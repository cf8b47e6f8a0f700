"""Near copies by MinHash with tensored banding, and their link components.

A document is the set of its word shingles; equal sets form one class. Two small collections
of sub-keys are made, each sub-key out of a few minhashes: A_1 .. A_r and B_1 .. B_r. The keys
of the r * r hash tables are the pairs (A_i, B_j). So 2 * r * k minhashes serve r * r tables of
2 * k minhashes each; without combining, these tables would take r times as many.

Two sets of similarity s share a table unless all A or all B differ, which happens with a
probability of at most 2 * (1 - s^k)^r: with k = 4 and r = 16, 1.5e-5 at s = 0.85 and 3.0e-7
at s = 0.9. Components hold together by further links, so fewer are missed in the result.

* A sub-key that only one class has leads to no table, so it goes first: most documents are
  like no other and never reach a table.
* In each table the classes of a bucket meet the bucket's smallest one. These candidates are
  verified by their whole sets, and what links is merged.
* Sets of one bucket that are still in different components meet in the lists of their shared
  A keys. Everything outside a list's largest component is held against the whole list, by
  size and parity bitmap; what may link visits the other component, and the visit is decided
  by the members' whole sets. No pairs of one component are formed, lists are cut into parts of
  bounded size (each two of which meet), and no candidate is left out.

Shingles are 64-bit hashes; a class is recognised by two 64-bit sums over its shingles.

Defined results. NULL, empty and blank texts are empty sets, linked with nothing. A document of
fewer words than a shingle is one shingle of all its words. Rows with a NULL doc_id are nodes
named by a hash of their text; the component's id is the smallest doc_id that is not NULL, and
NULL where there is none; ``kept`` then is true. Repeated rows give repeated result rows. Rows
that share a doc_id but not a text are documents of their own. A text of any length is read
whole; one text is in memory at a time, beside pieces of bounded size. Empty tables give no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.components import merge
from fleetrisk.llm.textbatch import MULTIPLIER, lists, mix, pieces
from fleetrisk.llm.verify import (apart_pairs, classes_of, linked, linked_pairs, pairs_in_reach, shingles, text_nodes,
                                  visit_links, visits_in_reach, wide_bitmaps)

SHINGLE = 5
PERCENT = 85
#: Sub-keys in each collection, and minhashes in each sub-key.
KEYS, ROWS = 16, 4
#: Parity bitmap of a set, in 64-bit words (1024 bits).
BITS = tuple(f"b{k}" for k in range(16))
#: Entries of one list that one task searches; a longer list is cut into lists of two parts each.
LIST_ROWS = 20_000


# ---------------------------------------------------------------- signatures

def sub_keys(sets: list[np.ndarray], keys: int = KEYS, rows: int = ROWS) -> np.ndarray:
    """The 2 * ``keys`` sub-keys of every non-empty set (a row each); the lowest bit tells B from A."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.zeros((len(sets), 2 * keys), np.uint64)
    for k in range(2 * keys):
        value = np.full(len(sets), np.uint64(k))
        for factor in mix(np.arange(1 + k * rows, 1 + (k + 1) * rows, dtype=np.uint64)) | np.uint64(1):
            value = value * np.uint64(MULTIPLIER) + np.minimum.reduceat(flat * factor, starts)
        out[:, k] = mix(value) & ~np.uint64(1) | np.uint64(k >= keys)
    return out


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    size = 64 * len(BITS)
    bits = np.zeros((len(sets), size), np.uint8)
    for k, s in enumerate(sets):
        bits[k] = np.bincount((s >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def _signatures(shingle: int, keys: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets = shingles(piece, shingle)
                some = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                sums = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                        for salt in (0x3C3C3C3C, 0xC3C3C3)]
                flat = sub_keys(some, keys, rows).ravel() if some else np.zeros(0, np.uint64)
                offsets = np.concatenate([[0], np.cumsum((n > 0) * 2 * keys)])
                bits = _parities(sets)
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("id"), pa.array(n), *[pa.array(s) for s in sums],
                     lists(flat.view(np.int64), offsets, pa.int64()), *[pa.array(bits[:, k]) for k in range(len(BITS))]],
                    names=["doc_id", "id", "n", "a", "b", "keys", *BITS])
    return run


# ---------------------------------------------------------------- lists that hold several components

def _whole_lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """One list after the other, from rows sorted by key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])) if batch.num_rows else []
        for begin, end in zip(cut, [*cut[1:], batch.num_rows]):
            if held and held[0][0][0] != columns[0][begin]:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append([c[begin:end] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _visits(percent: int):
    """(id, comp, members) for every entry and every larger component it may link with in its list."""
    names = ["key", "id", "n", "comp", "members", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_lists(batches, names):
            _, ids, n, comp, members = columns[:5]
            bits = np.stack(columns[5:], axis=1).view(np.uint64)
            names_, number, size = np.unique(comp, return_inverse=True, return_counts=True)
            main = number == np.argmax(size)
            order = np.concatenate([np.flatnonzero(~main), np.flatnonzero(main)])
            small, step = int((~main).sum()), max(1, 1_000_000 // len(order))
            ids, n, comp, members, bits = (c[order] for c in (ids, n, comp, members, bits))
            for begin in range(0, small, step):
                rows = np.arange(begin, min(begin + step, small))
                may = comp[rows, None] != comp[None, :]
                may &= np.arange(len(order))[None, :] > rows[:, None]
                may &= linked(np.minimum(n[rows, None], n[None, :]), n[rows, None], n[None, :], percent)
                x, y = np.nonzero(may)
                x = rows[x]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                ok = linked((n[x] + n[y] - apart) // 2, n[x], n[y], percent)
                x, y = x[ok], y[ok]
                swap = (members[x] > members[y]) | ((members[x] == members[y]) & (comp[x] < comp[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                both = np.unique(np.stack([ids[x], comp[y], members[y]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(3)], names=["id", "comp", "members"])
    return run


def _parts(entries: DataFrame, limit: int) -> DataFrame:
    """Entries with every list beyond the limit replaced by lists of two of its parts each."""
    sizes = entries.groupBy("key").agg((F.floor((F.count(F.lit(1)) - 1) * 2 / limit) + 1).alias("parts"))
    cut = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    two = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return cut.withColumn("key", F.when(F.col("parts") == 1, F.col("key")).otherwise(two)).select(*entries.columns)


def _mixed(entries: DataFrame) -> DataFrame:
    """The entries (with comp) of lists that hold several components."""
    mixed = entries.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return entries.join(mixed.where("low <> high").select("key"), "key", "left_semi")


# ---------------------------------------------------------------- the operator

_SETS = ("doc_id bigint, id bigint, n bigint, a bigint, b bigint, keys array<bigint>, "
         + ", ".join(f"{b} bigint" for b in BITS))


def _candidates(shared: DataFrame) -> DataFrame:
    """(id, pivot, count): every class with the smallest class of each of its buckets."""
    side = F.col("key").bitwiseAND(F.lit(1))
    own = shared.groupBy("id").agg(F.collect_list(F.when(side == 0, F.col("key"))).alias("left"),
                                   F.collect_list(F.when(side == 1, F.col("key"))).alias("right"))
    entries = own.select("id", F.explode("left").alias("left"), "right").select("id", "left", F.explode("right").alias("right"))
    entries = entries.select("id", F.xxhash64("left", "right").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    return entries.join(heads, "bucket").where("id <> pivot").groupBy("id", "pivot").count()


def _join(documents: DataFrame, percent: int, shingle: int, keys: int, rows: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, id, n, a, b) of all documents and labels (id, comp) of linked classes."""
    nodes = text_nodes(documents)
    sets = settle(nodes.mapInArrow(_signatures(shingle, keys, rows), _SETS), "sets")
    classes = sets.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("id", "keys")).alias("first"))
    single = settle(classes.select("first.id", F.explode("first.keys").alias("key")), "keys")
    often = single.groupBy("key").count().where("count > 1").select("key")
    shared = settle(single.join(often, "key", "left_semi"), "shared")
    pairs = settle(_candidates(shared), "pairs")

    ids = settle(pairs.select("id").union(pairs.select("pivot")).distinct(), "ids")
    texts = settle(nodes.join(ids, "id", "left_semi").select("id", "text").distinct(), "texts")
    wide = settle(texts.mapInArrow(wide_bitmaps(shingle), "id bigint, n bigint, wide binary"), "wide")
    labels = ids.select("id", F.col("id").alias("comp"))
    pairs = settle(pairs_in_reach(pairs, wide, percent), "pairs")
    best = pairs.groupBy("id").agg(F.max(F.struct("count", "pivot"))["pivot"].alias("x"))
    labels = merge(labels, linked_pairs(best.select("x", F.col("id").alias("y")), texts, percent, shingle))
    rest = settle(apart_pairs(pairs.select(F.col("pivot").alias("x"), F.col("id").alias("y")), labels), "rest")
    if not rest.isEmpty():
        labels = merge(labels, linked_pairs(rest, texts, percent, shingle))

    votes = pairs.groupBy(F.col("pivot").alias("id")).agg(F.sum("count").alias("votes"))
    entries = shared.where(F.col("key").bitwiseAND(F.lit(1)) == 0).join(ids, "id", "left_semi")
    looks = sets.join(ids, "id", "left_semi").select("id", "n", *BITS).distinct()
    for largest in (True, False):  # first each set and the largest component in its reach, then all
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
        named = _mixed(entries.join(labels, "id").join(sizes, "comp").select("key", "id", "comp", "members"))
        named = _mixed(_parts(named, limit)).join(looks, "id").select("key", "id", "n", "comp", "members", *BITS)
        named = named.repartition("key").sortWithinPartitions("key", "id")
        visits = named.mapInArrow(_visits(percent), "id bigint, comp bigint, members bigint").distinct()
        if largest:
            visits = visits.groupBy("id").agg(F.max(F.struct("members", "comp")).alias("to")).select("id", "to.comp", "to.members")
        visits = settle(visits, "visits")
        if visits.isEmpty():
            break
        visits = settle(visits_in_reach(visits, labels, wide, percent), "visits")
        labels = merge(labels, visit_links(visits, labels, votes, texts, percent, shingle))
    return sets.select("doc_id", "id", "n", "a", "b"), labels


def near_duplicates(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, keys: int = KEYS, rows: int = ROWS,
                    limit: int = LIST_ROWS) -> DataFrame:
    """Per document row: size of its set, the smallest doc_id that links reach, and whether it is that one."""
    sets, labels = _join(documents, percent, shingle, keys, rows, limit)
    classes = classes_of(sets, labels).select("a", "b", F.col("n").alias("size"), "component_id")
    joined = sets.join(classes, [sets["a"] == classes["a"], sets["b"] == classes["b"], sets["n"] == classes["size"]], "left")
    mine = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"),
                         F.col("doc_id").eqNullSafe(mine).alias("kept"))
