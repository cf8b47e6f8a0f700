"""Line dedup: exact copies and near copies of lines by a segment-partition edit join.

Two lines within ``EDITS`` edits (code points inserted, deleted or replaced) share one of
``EDITS + 1`` segments: whichever segment no edit hits occurs in the other line, moved by as
many places as edits allow. So every line puts its segments into an index under its length,
and probes the index of every length it may match with its own substrings at the places that
remain possible. Lines that meet are compared by a banded bit-parallel edit distance.

A line goes if an equal line starts earlier (smaller doc_id, or same document and earlier
line), or if its text first starts later than another text within ``EDITS`` edits of it.
Lines without a word never count; lines of less than ``LEAST`` code points have exact copies
only.

Of all keys only those move that can meet: a bitmap of the index keys goes to the texts again,
and a probe is sent only where it may meet another line's key; a bitmap of these probes then
decides which index entries go on. (A bitmap lets a few more through, never less.) Next, a
bitmap of hashed 3-grams (an edit flips six bits at most) drops pairs that are surely further
apart, inside the task, so a segment that many lines share does not send all its pairs on. Only
the texts of lines that are left in pairs are read out. Lines are known by 64-bit hashes.

Defined results. NULL, empty and blank texts have no lines. A document is named by its doc_id and
a 64-bit hash of its text: repeated rows are the same document, and each of them gives a
result row; different texts that share a doc_id follow each other by their hashes. Rows
without a doc_id come after all others, also by the hashes. A text of any length is read whole;
one text is in memory at a time, beside pieces of bounded size. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.bitmaps import bitmap, held_in
from fleetrisk.llm.jaccard import _complete
from fleetrisk.llm.textbatch import INVERSE, MULTIPLIER, NOT_SPACE, mix, pieces, powers

EDITS = 2
LEAST = 24
GRAM = 3
_LAST = (1 << 63) - 1
#: Bytes of text that one step works on.
STEP = 1 << 18
#: A random 64-bit value for every code point of two bytes.
_POINT_VALUE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: Bit of a bitmap of 128 bits, as two words.
_BIT = np.uint64(1) << (np.arange(128, dtype=np.uint64) & np.uint64(63))
_LOW, _HIGH = np.where(np.arange(128) < 64, _BIT, np.uint64(0)), np.where(np.arange(128) < 64, np.uint64(0), _BIT)


def point_values(points: np.ndarray) -> np.ndarray:
    """The values of any code points."""
    if points.max(initial=0) < len(_POINT_VALUE):
        return _POINT_VALUE[points]
    out = _POINT_VALUE[np.minimum(points, len(_POINT_VALUE) - 1)]
    far = np.flatnonzero(points >= len(_POINT_VALUE))
    out[far] = mix(points[far].astype(np.uint64) + np.uint64(1))
    return out


class Lines:
    """The lines with a word of a piece, as code points."""

    def __init__(self, piece):
        data = piece.data
        cut = np.zeros(len(data) + 1, bool)
        cut[piece.starts] = True
        cut[1:][data == 0x0A] = True
        begin = np.flatnonzero(cut[:-1])
        stop = np.append(begin[1:], len(data)) if len(begin) else begin
        end = stop - (data[stop - 1] == 0x0A)
        row = np.searchsorted(piece.starts, begin, "right") - 1
        first = np.searchsorted(row, np.arange(len(piece)))
        number = np.arange(len(begin)) - first[row] if len(begin) else begin
        # The line feed at a line's end is no word.
        full = np.logical_or.reduceat(NOT_SPACE[data], begin) if len(begin) else np.zeros(0, bool)
        self.row, self.number = row[full], number[full]
        self.byte_begin, self.byte_end = begin[full], end[full]
        if not len(data) or data.max() < 0x80:  # a code point is a byte
            self.begin, self.end = self.byte_begin, self.byte_end
            self.values = _POINT_VALUE[data]
        else:
            size = np.add.reduceat((data & 0xC0) != 0x80, begin, dtype=np.int64)  # code points, with the line feed
            after = np.cumsum(size)
            self.begin, self.end = (after - size)[full], (after - (stop - end))[full]
            self.values = point_values(np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
        n = len(self.values)
        self.total = np.zeros(n + 1, np.uint64)
        np.multiply(self.values, powers(MULTIPLIER, n), out=self.total[1:])
        np.cumsum(self.total, out=self.total)
        self.inverse = powers(INVERSE, n + 1)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def segments(length: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begin and size of each segment of lines of these lengths: even, longer ones last."""
    parts = edits + 1
    short = length // parts
    longer = length - short * parts
    out = []
    for i in range(parts):
        begin = i * short + np.maximum(0, i - (parts - longer))
        out.append((begin, short + (i >= parts - longer)))
    return out


def keys(lines: Lines, chosen: np.ndarray, edits: int = EDITS, probes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, which of ``chosen``, kind): kind 0 is an index entry, 1 a probe."""
    begin, size = lines.begin[chosen], lines.end[chosen] - lines.begin[chosen]
    every = np.arange(len(chosen))
    for shorter in range(edits + 1):  # probes go to lines of the same length or shorter
        length = size - shorter
        for i, (at, width) in enumerate(segments(length, edits)):
            label = mix((length.astype(np.uint64) << np.uint64(8)) + np.uint64(i))
            if shorter == 0:
                start = begin + at
                yield lines.hashes(start, start + width) ^ label, every, 0
            if not probes:
                continue
            # Places that edits to the left and to the right of the segment leave possible.
            low = np.maximum(np.maximum(0, at - i), at + shorter - (edits - i))
            high = np.minimum(np.minimum(size - width, at + i), at + shorter + (edits - i))
            for move in range(2 * edits + 1):
                place = low + move
                ok = np.flatnonzero(place <= high)
                if len(ok):
                    start = begin[ok] + place[ok]
                    yield lines.hashes(start, start + width[ok]) ^ label[ok], ok, 1


def _chosen(piece) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The lines of a piece, the first of each different one that may have near copies, and their hashes."""
    lines = Lines(piece)
    own = lines.hashes(lines.begin, lines.end)
    _, chosen = np.unique(own, return_index=True)
    chosen = chosen[lines.end[chosen] - lines.begin[chosen] >= LEAST]
    return lines, chosen, own[chosen].view(np.int64)


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind 0, line) of the lines' own segments."""
    for batch in batches:
        for piece in pieces(batch.column("text"), STEP):
            lines, chosen, ids = _chosen(piece)
            for key, which, kind in keys(lines, chosen, probes=False):
                yield _entries(key, kind, ids[which])


def _known_keys(known: np.ndarray):
    """The entries whose key is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(held_in([known], key)))
    return run


def _probe_keys(index: np.ndarray, shared: np.ndarray):
    """(key, kind 1, line) of probes that may meet another line's segment.

    A probe that is one of the line's own segments counts only where another line has it, too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), STEP):
                lines, chosen, ids = _chosen(piece)
                own: list[np.ndarray] = []
                for key, which, kind in keys(lines, chosen):
                    if kind == 0:
                        own.append(key)
                        continue
                    may = held_in([index], key)
                    key, which = key[may], which[may]
                    mine = np.zeros(len(key), bool)
                    for segment in own:
                        mine |= key == segment[which]
                    mine[mine] = ~held_in([shared], key[mine])
                    yield _entries(key[~mine], 1, ids[which[~mine]])
    return run


def _entries(key: np.ndarray, kind: int, line: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int64)), pa.array(line)],
                                      names=["key", "kind", "line"])


def gram_bits(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The 3-gram bitmap of every line, as two words: the parities of its grams' 128 bits."""
    size = lines.end - lines.begin
    low, high = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    some = np.flatnonzero(size >= GRAM)
    if len(some):
        value = (lines.values >> np.uint64(32)).astype(np.uint32)  # already scrambled
        gram = value[:-2] * np.uint32(3) + value[1:-1] * np.uint32(5) + value[2:] * np.uint32(7)
        bit = gram >> np.uint32(25)
        # Every second range is a line's grams; the last one ends where the next line's or nothing begins.
        ranges = np.stack([lines.begin[some], lines.end[some] - (GRAM - 1)], axis=1).ravel()
        ranges = ranges[:-1] if ranges[-1] >= len(bit) else ranges
        for words, out in ((_LOW, low), (_HIGH, high)):
            out[some] = np.bitwise_xor.reduceat(words[bit], ranges)[::2].view(np.int64)
    return low, high


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, name, number, line, size, g0, g1) of every line; g0 and g1 are the 3-gram bitmap."""
    for batch in batches:
        ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "name"))
        for piece in pieces(batch.column("text"), STEP):
            lines = Lines(piece)
            own = lines.hashes(lines.begin, lines.end).view(np.int64)
            low, high = gram_bits(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[piece.first + lines.row]), pa.array(texts[piece.first + lines.row]), pa.array(lines.number), pa.array(own),
                 pa.array(lines.end - lines.begin), pa.array(low), pa.array(high)],
                names=["id", "name", "number", "line", "size", "g0", "g1"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of keys that an index entry and a probe of another line share."""
    names = ["key", "kind", "line"]
    for columns, part in _complete(batches, names):
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        key, kind, line = (c[new] for c in columns)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        both = (np.minimum.reduceat(kind, begin) != np.maximum.reduceat(kind, begin))
        both &= np.minimum.reduceat(line, begin) != np.maximum.reduceat(line, begin)
        keep = both[own] | part
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, kind, line)], names=names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): index line and probing line that may be within reach of each other."""
    names = ["key", "kind", "line", "size", "g0", "g1"]
    for columns, _ in _complete(batches, names):
        key, kind, line, size = columns[:4]
        bits = np.stack(columns[4:], axis=1).view(np.uint64)
        starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        probes = np.add.reduceat(kind, starts[:-1])
        for b, e, n in zip(starts[:-1], starts[1:], probes):
            index, probe = np.arange(b, e - n), np.arange(e - n, e)
            step = max(1, 1_000_000 // max(1, len(index)))
            for at in range(0, len(probe), step):
                x = np.repeat(index, len(probe[at:at + step]))
                y = np.tile(probe[at:at + step], len(index))
                ok = (line[x] != line[y]) & (np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= 2 * GRAM * EDITS)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(line[x[ok]]), pa.array(line[y[ok]])], names=["x", "y"])


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Is the edit distance at most ``edits``? Bit-parallel over a band of 2 * edits + 1 diagonals.

    Bit d of level k says that k edits lead from the start to diagonal d of the band; one
    character of ``a`` moves all diagonals at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    high = min(len(a), len(b))
    low = 0
    while low < high and a[-1 - low] == b[-1 - low]:
        low += 1
    a, b = a[:len(a) - low], b[:len(b) - low]
    width = 2 * edits + 1
    mask = (1 << width) - 1
    levels = [0] * (edits + 1)
    for k in range(edits + 1):
        for j in range(k + 1):
            levels[k] |= 1 << (edits + j)
    for i, c in enumerate(a):
        equal = 0
        for d in range(width):  # diagonal d stands for j = i + d - edits
            j = i + d - edits
            if 0 <= j < len(b) and b[j] == c:
                equal |= 1 << d
        before, levels[0] = levels[0], levels[0] & equal
        for k in range(1, edits + 1):
            old = levels[k]
            # match | replace | delete from a | insert into a
            now = (old & equal) | before | (before >> 1)
            levels[k] = (now | (levels[k - 1] << 1)) & mask
            before = old
        if not levels[edits]:
            return False
    end = len(b) - len(a) + edits
    return 0 <= end < width and bool(levels[edits] >> end & 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("text_x").to_pylist(), batch.column("text_y").to_pylist()
        ok = pa.array([within(a, b) for a, b in zip(x, y)], pa.bool_())
        yield batch.select(["x", "y"]).filter(ok)


def _line_texts(wanted: np.ndarray):
    """Hash and text of the lines whose hash is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), STEP):
                lines, chosen, ids = _chosen(piece)
                some = held_in([wanted], ids.view(np.uint64))
                text = [piece.data[lines.byte_begin[k]:lines.byte_end[k]].tobytes() for k in chosen[some]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(text, pa.binary()).cast(pa.string())], names=["line", "text"])
    return run


def near_lines(texts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(x, y): different line texts within ``EDITS`` edits, each pair once or twice."""
    text, entry = texts.select("text"), "key bigint, kind bigint, line bigint"
    entries = settle(text.mapInArrow(_index_keys, entry), "entries")
    own = entries.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    own = settle(own.select("key", (F.col("low") < F.col("high")).alias("shared")), "segments")
    index, shared = bitmap(own.select("key")), bitmap(own.where("shared").select("key"))
    probes = settle(text.mapInArrow(_probe_keys(index, shared), entry).distinct(), "probes")
    asked = bitmap(probes.select("key").distinct())
    keyed = entries.mapInArrow(_known_keys(asked), entry).distinct().union(probes)
    keyed = keyed.repartition("key").sortWithinPartitions("key", "kind", "line")
    met = settle(keyed.mapInArrow(_met, entry), "met")
    looks = occurrences.join(met.select("line").distinct(), "line", "left_semi").groupBy("line").agg(
        *[F.first(c).alias(c) for c in ("size", "g0", "g1")])
    pairs = (met.join(looks, "line").select("key", "kind", "line", "size", "g0", "g1")
             .repartition("key").sortWithinPartitions("key", "kind", "line"))
    pairs = settle(pairs.mapInArrow(_pairs, "x bigint, y bigint").distinct(), "pairs")
    wanted = settle(pairs.select(F.col("x").alias("line")).union(pairs.select("y")).distinct(), "wanted")
    known = text.mapInArrow(_line_texts(bitmap(wanted.select(F.col("line").alias("key")))), "line bigint, text string")
    known = settle(known.groupBy("line").agg(F.min("text").alias("text")), "lines")
    both = (pairs.join(known.select(F.col("line").alias("x"), F.col("text").alias("text_x")), "x")
            .join(known.select(F.col("line").alias("y"), F.col("text").alias("text_y")), "y"))
    return both.select("x", "y", "text_x", "text_y").mapInArrow(_verified, "x bigint, y bigint")


def _named(documents: DataFrame) -> DataFrame:
    """(doc_id, id, name, text): id orders the documents, id and name are one document."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("name"), text.alias("text"))


def line_marks(documents: DataFrame) -> DataFrame:
    """(id, name, number, line, exact, near) for every line with a word."""
    texts = _named(documents).select("id", "name", "text")
    schema = "id bigint, name bigint, number bigint, line bigint, size bigint, g0 bigint, g1 bigint"
    found = settle(texts.mapInArrow(_occurrences, schema), "occurrences")
    firsts = settle(found.groupBy("line").agg(F.min(F.struct("id", "name", "number")).alias("first")), "firsts")
    links = near_lines(texts, found)
    links = links.union(links.select("y", "x")).distinct()
    named = (links.join(firsts.select(F.col("line").alias("x"), F.col("first").alias("first_x")), "x")
             .join(firsts.select(F.col("line").alias("y"), F.col("first").alias("first_y")), "y"))
    near = named.where("first_x > first_y").select(F.col("x").alias("line"), F.lit(True).alias("near")).distinct()
    marks = found.select("id", "name", "number", "line").join(firsts.join(near, "line", "left"), "line")
    return marks.select("id", "name", "number", "line", (F.struct("id", "name", "number") != F.col("first")).alias("exact"),
                        F.coalesce("near", F.lit(False)).alias("near"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Per document row: lines with a word, lines that are exact copies, other lines that are near copies."""
    per = line_marks(documents).distinct().groupBy("id", "name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("exact").cast("bigint")).alias("copies"),
        F.sum((~F.col("exact") & F.col("near")).cast("bigint")).alias("near"))
    rows = _named(documents).select("doc_id", "id", "name").join(per, ["id", "name"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", F.coalesce("lines", zero).alias("n_lines"), F.coalesce("copies", zero).alias("n_exact"),
                       F.coalesce("near", zero).alias("n_near"))
