"""Exact verification of candidate near copies: pairs of texts, and visits of a text to a component.

Candidates come from whatever found them. Before whole texts move, parity bitmaps that grow with
the set (two to four bits a shingle) exclude what cannot link. Pairs are then compared by their
whole sets, the partners of one text in parts of bounded size. For a visit, the members of the
component are known by their differences from a centre, so that a visitor's overlap with all of
them follows from its overlap with the centre; a large component is held in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.textbatch import NOT_SPACE, Piece, pieces, window_hashes

#: Sets of more shingles get a parity bitmap that grows with the set.
WIDE_FROM = 256
#: Partners of one text that one task compares with it.
PARTNERS = 500
#: Members of a component that one task compares with its visitors.
MEMBERS = 20_000
#: Bytes of members' wide bitmaps that one task holds, on average.
WIDE_BYTES = 64 << 20


def shingles(piece: Piece, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    w = piece.words(NOT_SPACE, lower=True)
    hashes = w.hashes()
    windows = window_hashes(hashes, n)
    out = []
    for begin, end in zip(w.of[:-1].tolist(), w.of[1:].tolist()):
        if end - begin >= n:
            out.append(np.unique(windows[begin:end - n + 1]))
        else:
            out.append(window_hashes(hashes[begin:end], end - begin) if end > begin else hashes[:0])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(common, size_x, size_y, percent: int = 90):
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (size_x + size_y)


# ---------------------------------------------------------------- bitmaps that grow with the set

def parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of two to four bits a shingle; its length is a power of two."""
    bits = max(1024, 1 << (2 * len(s) - 1).bit_length())
    ones = np.bincount((s >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller power of two."""
    return bitmap if len(bitmap) == words else np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _may(x: np.ndarray | None, y: np.ndarray | None, size_x: int, size_y: int, percent: int) -> bool:
    """Whether two sets may link, by their sizes and as far as wide bitmaps tell (None: no bitmap)."""
    apart = 0
    if x is not None and y is not None:
        words = min(len(x), len(y))
        apart = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum(dtype=np.int64))
    return bool(linked(min(size_x, size_y, (size_x + size_y - apart) // 2), size_x, size_y, percent))


def _unpacked(column: pa.Array) -> Iterator[np.ndarray | None]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.uint64) if value.is_valid else None


def wide_bitmaps(shingle: int, wide_from: int = WIDE_FROM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets = shingles(piece, shingle)
                wide = [parity(s).tobytes() if len(s) > wide_from else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(piece.first, len(piece)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(wide, pa.binary())], names=["id", "n", "wide"])
    return run


def _near_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n").to_pylist(), batch.column("pivot_n").to_pylist())
            both = zip(_unpacked(batch.column("wide")), _unpacked(batch.column("pivot_wide")), sizes)
            ok = pa.array([_may(x, y, *n, percent) for x, y, n in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("id", "pivot", "count")], names=["id", "pivot", "count"])
    return run


def pairs_in_reach(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (id, pivot, count) that may link by their wide bitmaps."""
    other = wide.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("wide").alias("pivot_wide"))
    rows = pairs.join(wide, "id").join(other, "pivot").select("id", "pivot", "count", "n", "wide", "pivot_n", "pivot_wide")
    return rows.mapInArrow(_near_pairs(percent), "id bigint, pivot bigint, count bigint").distinct()


class Held:
    """Members of a component by the length of their wide bitmaps (0: none)."""

    def __init__(self):
        self.new, self.stacks = {}, {}

    def add(self, bitmap: np.ndarray | None, n: int) -> None:
        self.new.setdefault(0 if bitmap is None else len(bitmap), []).append((bitmap, n))

    def may(self, bitmap: np.ndarray | None, n: int, percent: int) -> bool:
        """Whether some member may link with the visiting set."""
        for words, rows in self.new.items():
            self.stacks[words] = (np.stack([b for b, _ in rows]) if words else None, np.array([m for _, m in rows]))
        self.new = {}
        for words, (bitmaps, sizes) in self.stacks.items():
            ok = np.flatnonzero(linked(np.minimum(sizes, n), n, sizes, percent))
            if not len(ok) or bitmap is None or not words:
                if len(ok):
                    return True
                continue
            both = min(words, len(bitmap))
            step = max(1, (1 << 20) // words)
            for k in range(0, len(ok), step):  # 8 MB of bitmaps at a time
                at = ok[k:k + step]
                mine = np.bitwise_xor.reduce(bitmaps[at].reshape(len(at), -1, both), axis=1)
                apart = np.bitwise_count(mine ^ fold(bitmap, both)).sum(axis=1, dtype=np.int64)
                if linked((sizes[at] + n - apart) // 2, n, sizes[at], percent).any():
                    return True
        return False


def _near_families(percent: int):
    """Rows of one family follow each other, members (1) before visitors (2): visitors that may link with a member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Held()
        for batch in batches:
            found = ([], [])
            columns = (batch.column(c).to_pylist() for c in ("comp", "part", "kind", "id", "n"))
            for comp, part, kind, id_, n, bitmap in zip(*columns, _unpacked(batch.column("wide"))):
                if (comp, part) != now:
                    now, held = (comp, part), Held()
                if kind == 1:
                    held.add(bitmap, n)
                elif held.may(bitmap, n, percent):
                    found[0].append(id_)
                    found[1].append(comp)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["id", "comp"])
    return run


def visits_in_reach(visits: DataFrame, labels: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Those of the visits (id, comp, members) that may link by the members' wide bitmaps."""
    members = labels.join(visits.select("comp").distinct(), "comp", "left_semi").join(wide, "id")
    # Four bits a shingle at most.
    parts = members.groupBy("comp").agg(
        (F.floor(F.greatest(F.sum("n") / (2 * WIDE_BYTES), F.count(F.lit(1)) / MEMBERS)) + 1).alias("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    rows = (members.join(parts, "comp").select("comp", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(1).alias("kind"), "id", "n", "wide")
            .union(visits.join(parts, "comp").select("comp", "id", every).join(wide, "id")
                   .select("comp", "part", F.lit(2).alias("kind"), "id", "n", "wide")))
    rows = rows.repartition("comp", "part").sortWithinPartitions("comp", "part", "kind", "id")
    near = rows.mapInArrow(_near_families(percent), "id bigint, comp bigint").distinct()
    return visits.join(near, ["id", "comp"], "left_semi")


# ---------------------------------------------------------------- exact comparisons

def _compare(percent: int, shingle: int):
    """Rows of one x and part follow each other, x's own text first: links of x with the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            x, part, y = (batch.column(c).to_pylist() for c in ("x", "part", "y"))
            found = ([], [])
            for piece in pieces(batch.column("text")):
                for k, s in enumerate(shingles(piece, shingle), piece.first):
                    if y[k] is None:
                        sets = [*sets, s] if (x[k], part[k]) == now else [s]
                        now = x[k], part[k]
                    elif (x[k], part[k]) == now and any(linked(overlap(s, c), len(s), len(c), percent) for c in sets):
                        found[0].append(x[k])
                        found[1].append(y[k])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["x", "y"])
    return run


def linked_pairs(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Those of the pairs (x, y) that link. The partners of one x are dealt out in parts of bounded size."""
    parts = pairs.groupBy("x").agg((F.floor(F.count(F.lit(1)) / PARTNERS) + 1).alias("parts"))
    others = pairs.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), "parts"))
    others = others.join(texts, others["y"] == texts["id"]).select("x", "part", "y", "text")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    own = parts.join(texts, F.col("x") == texts["id"]).select("x", every, F.lit(None).cast("bigint").alias("y"), "text")
    rows = others.union(own).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    return settle(rows.mapInArrow(_compare(percent, shingle), "x bigint, y bigint"), "links")


class Family:
    """A centre and members known by their differences from it."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        self.ids, self.sizes, self.lost, self.extra = [], [], [], []

    def add(self, member: int, s: np.ndarray) -> None:
        self.ids.append(member)
        self.sizes.append(len(s))
        self.lost.append(np.flatnonzero(~np.isin(self.centre, s, assume_unique=True)))
        self.extra.append(np.setdiff1d(s, self.centre, assume_unique=True))

    def close(self) -> None:
        self.sizes = np.array(self.sizes)
        self.less = np.array([len(x) for x in self.lost])
        self.more = np.array([len(x) for x in self.extra])
        self.lost_at, self.extra_at = np.concatenate(self.lost), np.concatenate(self.extra)
        self.lost_from = np.concatenate([[0], np.cumsum(self.less)])
        self.extra_from = np.concatenate([[0], np.cumsum(self.more)])

    def visit(self, s: np.ndarray, percent: int) -> int | None:
        """A member that links with the visiting set, if there is one."""
        shared = np.isin(self.centre, s, assume_unique=True)
        common = int(shared.sum())
        bound = np.minimum(common, len(self.centre) - self.less) + self.more
        if not linked(bound, len(s), self.sizes, percent).any():
            return None
        lost = np.concatenate([[0], np.cumsum(shared[self.lost_at])])
        extra = np.concatenate([[0], np.cumsum(np.isin(self.extra_at, s))])
        overlap = common - (lost[self.lost_from[1:]] - lost[self.lost_from[:-1]])
        overlap = overlap + extra[self.extra_from[1:]] - extra[self.extra_from[:-1]]
        hit = np.flatnonzero(linked(overlap, len(s), self.sizes, percent))
        return self.ids[hit[0]] if len(hit) else None


def _families(percent: int, shingle: int):
    """Rows of one family follow each other: centre (0), members (1), visitors (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, closed = None, None, False
        for batch in batches:
            comp, part, kind, ids = (batch.column(c).to_pylist() for c in ("comp", "part", "kind", "id"))
            found = ([], [])
            for piece in pieces(batch.column("text")):
                for k, s in enumerate(shingles(piece, shingle), piece.first):
                    if kind[k] == 0:
                        if now != (comp[k], part[k]):
                            now, family, closed = (comp[k], part[k]), Family(s), False
                        family.add(ids[k], s)
                    elif now != (comp[k], part[k]):
                        continue
                    elif kind[k] == 1:
                        family.add(ids[k], s)
                    else:
                        if not closed:
                            family.close()
                            closed = True
                        member = family.visit(s, percent)
                        if member is not None:
                            found[0].append(ids[k])
                            found[1].append(member)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["x", "y"])
    return run


def visit_links(visits: DataFrame, labels: DataFrame, votes: DataFrame, texts: DataFrame, percent: int,
                 shingle: int) -> DataFrame:
    """A link for every visit (id, comp) that has one."""
    families = visits.select("comp", (F.floor((F.col("members") - 1) / MEMBERS) + 1).alias("parts")).distinct()
    members = (labels.join(families, "comp").join(votes, "id", "left")
               .withColumn("votes", F.coalesce("votes", F.lit(0))))
    centres = members.groupBy("comp", "parts").agg(F.max(F.struct("votes", "id"))["id"].alias("id"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    rows = (centres.select("comp", every, F.lit(0).alias("kind"), "id")
            .union(members.join(centres.select("id", F.lit(True).alias("centre")), "id", "left").where("centre is null")
                   .select("comp", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(1).alias("kind"), "id"))
            .union(visits.join(families, "comp").select("comp", every, F.lit(2).alias("kind"), "id")))
    rows = rows.join(texts, "id").select("comp", "part", "kind", "id", "text")
    rows = rows.repartition("comp", "part").sortWithinPartitions("comp", "part", "kind", "id")
    return settle(rows.mapInArrow(_families(percent, shingle), "x bigint, y bigint"), "links")


# ---------------------------------------------------------------- nodes and classes

def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_nodes(documents: DataFrame, name: str) -> DataFrame:
    """The rows with the name of their node: the doc_id, or a hash of doc_id and text.

    The hash stands for rows without a doc_id, and for rows whose doc_id also stands at another
    text: such rows are documents of their own.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    ids = documents.select(doc_id.alias("twice"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("f")).where("twice IS NOT NULL")
    twice = ids.groupBy("twice").agg(F.min("f").alias("low"), F.max("f").alias("high")).where("low <> high").select("twice")
    twice = settle(twice, "twice")
    if twice.isEmpty():
        return documents.withColumn(name, F.coalesce(doc_id, F.xxhash64(doc_id, text)))
    mark = free_name(documents, "twice")
    marked = documents.join(twice.withColumnRenamed("twice", mark), doc_id == F.col(mark), "left")
    return marked.withColumn(name, F.coalesce(F.when(F.col(mark).isNull(), doc_id), F.xxhash64(doc_id, text))).drop(mark)


def text_nodes(documents: DataFrame) -> DataFrame:
    """(doc_id, id, text): ``id`` names the row's node."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_nodes(rows, "id").select("doc_id", "id", "text")


def apart_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    left = labels.select(F.col("id").alias("x"), F.col("comp").alias("cx"))
    right = labels.select(F.col("id").alias("y"), F.col("comp").alias("cy"))
    return pairs.join(left, "x").join(right, "y").where("cx <> cy").select("x", "y")


def classes_of(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, n, comp, component_id) for every class that isn't empty."""
    classes = sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"))
    named = classes.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.drop("doc_id").join(smallest, "comp")
