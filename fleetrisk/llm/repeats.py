"""Removal of long repeats with a run-length index of the repeated passages.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier. The corpus
is too large for one index, so every string of that length is first given an anchor: its
smallest hashed ``GRAM``-byte piece (the leftmost of equals). Equal strings have equal
anchors at equal places. The bytes of all strings in a row that share an anchor are a context.

* Exact copies of a text are whole repeats of the first one (smallest doc_id). Only the first
  one goes on; texts that a bitmap of the repeated fingerprints rules out are not shuffled.
* Anchors are counted over the corpus. An anchor seen once cannot lie in a repeat; a bitmap of
  the others decides, in a second pass over the texts, which contexts are cut out at all.
* Equal contexts are one class. All but the first of a class are repeats as a whole, and only
  the first goes on, and only where its anchor has several classes.
* The contexts of an anchor that has many are cut by the anchor's place in the string, into
  parts that each share the bytes which all strings of that part hold around the anchor. Equal
  strings still meet, and no anchor is one task however many surroundings it has.
* In a task the contexts of each anchor are halved again and again. The earlier halves form a
  run-length index: the Burrows-Wheeler transform as runs of equal bytes, with the text position
  sampled at both ends of every run. The later halves are streamed through it from right to left
  by matching statistics: while the byte is the one before the current row, the match grows; if
  not, the stream goes on from the nearest run end of that byte, whose sampled position says how
  much of the match is left. A match of ``LENGTH`` bytes is a string that also starts earlier.

Defined results. NULL texts are empty: no bytes, nothing removed, the checksum of no bytes.
Texts shorter than ``LENGTH`` lose nothing. Rows without a doc_id come after all others.
A document is named by its doc_id and its text's fingerprints (64 bits and a tag of 16 more):
repeated rows are the same document and are judged alike; different texts that share a doc_id,
or have none, follow each other by fingerprint. Contexts are equal when two 64-bit hashes are.
A text of any length is read whole; one text is in memory at a time, beside pieces of bounded
size. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.bitmaps import Counts, bitmap, held_in
from fleetrisk.llm.textbatch import BYTE_VALUE, INVERSE, MULTIPLIER, mix, pieces, powers, span_hashes, utf8

LENGTH = 100
GRAM = 48
#: Bytes of contexts that go through the index together (one anchor's contexts at least).
BLOCK_BYTES = 1 << 20
#: Classes of contexts from which an anchor's are cut by place.
CROWDED = 2_000
#: Places of the anchor in the string that one such part takes.
PLACES = 14
#: Anchors whose counts a task holds before it hands them out.
HELD = 1_000_000
#: Bytes of text (arrays over so many stay in a core's cache), and contexts, that one step works on.
PIECE, STEP = 1 << 16, 10_000
#: Texts that are copied at once.
ROWS = 1_000

_TAG = (1 << 16) - 1
_LAST = (1 << 63) - 1
#: The least value that fills so many bytes, from one to eight.
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, row, begin, count, offset) of each run of strings that share an anchor.

    ``offset`` is the anchor's place in the first string of the run.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none
    h = _gram_hashes(data, gram)
    lowest = _window(np.minimum, h, length - gram + 1)
    # A place can be an anchor if some string around it has no lower hash.
    edge = np.zeros(length - gram, np.uint64)
    places = np.flatnonzero(_window(np.maximum, np.concatenate([edge, lowest, edge]), length - gram + 1) == h)
    at = _leftmost(h, lowest, places)
    begin = np.arange(len(at))
    row = np.searchsorted(starts, begin, "right") - 1
    whole = begin + length <= starts[row + 1]
    begin, row, at = begin[whole], row[whole], at[whole]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return (h[at[first]], row[first], begin[first] - starts[row[first]], np.diff(np.append(first, len(at))),
            at[first] - begin[first])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all pieces of ``gram`` bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(MULTIPLIER, n), out=total[1:])
    return mix((total[gram:] - total[:n - gram + 1]) * powers(INVERSE, n + 1)[:n - gram + 1] + np.uint64(gram))


def _window(best, values: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = best(values[:-step], values[step:])
        span += step
    return values


def _leftmost(h: np.ndarray, lowest: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For every window its first place with the window's lowest value."""
    seen = np.zeros(len(h) + 1, np.int32)
    seen[places + 1] = 1
    next_place = np.cumsum(seen, dtype=np.int32)[:len(lowest)]  # the first of the places not before the window
    live = np.flatnonzero(h[places[next_place]] != lowest)
    while len(live):
        next_place[live] += 1
        live = live[h[places[next_place[live]]] != lowest[live]]
    return places[next_place]


class RunIndex:
    """Run-length Burrows-Wheeler index of short strings.

    ``data`` holds the strings one after the other, string k is data[starts[k]:starts[k+1]].
    A suffix ends with its string; equal suffixes are in string order. Strings of different
    ``parts`` (numbers in order, one for each string) have nothing in common: their bytes count
    as different symbols, so one index serves many small sets of strings.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, parts: np.ndarray):
        strings = len(starts) - 1
        sizes = np.diff(starts)
        n = len(data) + strings
        code = np.zeros(n, np.uint8)  # 0 ends a string; no UTF-8 byte is 255
        inside = np.ones(n, bool)
        self.stops = starts[1:] + np.arange(strings)
        inside[self.stops] = False
        code[inside] = data + 1
        left = np.repeat(self.stops, sizes + 1) - np.arange(n)  # bytes up to the string's end
        part = np.repeat(parts, sizes + 1).astype(np.int64)
        self.code, self.left = part * 257 + code, left

        key, size = code.astype(np.uint64), 1
        while size < 8:
            later = np.zeros(n, np.uint64)
            later[:-size] = key[size:]
            key = (key << np.uint64(8 * size)) | np.where(left > size - 1, later, 0)
            size *= 2
        self.eight, self.part = key, part  # the eight bytes from each place on, zeros behind the string's end
        _, rank = self._ranks(key)
        _, rank = self._ranks(part * np.int64(n + 1) + rank)
        while size < int(sizes.max()) + 1:
            later = np.zeros(n, np.int64)
            later[:-size] = rank[size:] + 1
            _, rank = self._ranks(rank * np.int64(n + 1) + np.where(left > size - 1, later, 0))
            size *= 2
        order = np.argsort(rank * np.int64(n) + np.arange(n))
        self._runs(order)

    @staticmethod
    def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        new = np.ones(len(key), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        new[0] = 0
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        return order, rank

    def _runs(self, order: np.ndarray) -> None:
        """Runs of the transform with their first row, step to the next row, and end samples."""
        before = self.code[order - 1]  # the text is taken as a ring
        new = np.append(True, before[1:] != before[:-1])
        self.run_start = np.flatnonzero(new)
        self.head = before[self.run_start]
        size = np.diff(np.append(self.run_start, len(order)))
        by_head = np.argsort(self.head, kind="stable")
        target = np.empty(len(size), np.int64)
        target[by_head] = np.concatenate([[0], np.cumsum(size[by_head])[:-1]])
        self.step = target - self.run_start
        self.first_at, self.last_at = order[self.run_start], order[self.run_start + size - 1]
        self.by_head, self.heads, self.size = by_head, self.head[by_head], size
        # Runs of one byte stand in row order within by_head.
        self.key = self.heads * (len(size) + 1) + by_head

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, ``most`` at most; eight bytes are compared at a time."""
        most = np.where(self.part[a] == self.part[b], np.minimum(most, np.minimum(self.left[a], self.left[b])), 0)
        out = most.copy()
        live = np.flatnonzero(most > 0)
        a, b, most = a[live], b[live], most[live]
        for k in range(0, int(most.max()) if len(live) else 0, 8):
            differ = self.eight[a + k] ^ self.eight[b + k]
            end = np.flatnonzero(differ)
            out[live[end]] = np.minimum(k + 8 - np.searchsorted(_BYTES, differ[end], "right"), most[end])
            on = np.flatnonzero((differ == 0) & (most > k + 8))
            if not len(on):
                break
            live, a, b, most = live[on], a[on], b[on], most[on]
        return out

    def matching_statistics(self, data: np.ndarray, starts: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """For every byte of the patterns: length of its match with strings of the pattern's part.

        All patterns move on by a byte at a time, from their right ends.
        """
        sizes = np.diff(starts)
        length = np.zeros(len(data), np.int64)
        row = np.zeros(len(sizes), np.int64)
        place = np.full(len(sizes), self.stops[0])  # text position of the row's suffix
        match = np.zeros(len(sizes), np.int64)
        live = np.flatnonzero(sizes > 0)
        for back in range(1, int(sizes.max()) + 1 if len(sizes) else 0):
            live = live[sizes[live] >= back]
            c = parts[live] * np.int64(257) + data[starts[live + 1] - back] + 1
            run = np.searchsorted(self.run_start, row[live], "right") - 1
            off = np.flatnonzero(self.head[run] != c)
            if len(off):
                self._jump(live[off], c[off], run, off, row, place, match)
            known = self.head[run] == c
            mine = live[known]
            row[mine] += self.step[run[known]]
            place[mine] -= 1
            match[mine] += 1
            lost = live[~known]  # a byte that the index does not have
            row[lost], place[lost], match[lost] = 0, self.stops[0], 0
            at = starts[live + 1] - back
            length[at] = match[live]
        return length

    def _jump(self, lanes, c, run, off, row, place, match) -> None:
        """Moves lanes to the nearer-matching run end of their byte, above or below."""
        low, high = np.searchsorted(self.heads, c, "left"), np.searchsorted(self.heads, c, "right")
        have = low < high
        lanes, c, off, low, high = lanes[have], c[have], off[have], low[have], high[have]
        if not len(lanes):
            return
        nxt = np.searchsorted(self.key, c * (len(self.run_start) + 1) + run[off])
        best = np.full(len(lanes), -1, np.int64)
        r, at = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        at_end = np.zeros(len(lanes), bool)
        for side, samples, end in ((nxt - 1, self.last_at, True), (nxt, self.first_at, False)):
            ok = (side >= low) & (side < high)
            candidate = self.by_head[np.where(ok, side, low)]
            common = np.where(ok, self._common(place[lanes], samples[candidate], match[lanes]), -1)
            better = common > best
            best = np.where(better, common, best)
            r, at = np.where(better, candidate, r), np.where(better, samples[candidate], at)
            at_end = np.where(better, end, at_end)
        row[lanes] = self.run_start[r] + np.where(at_end, self.size[r] - 1, 0)
        place[lanes], match[lanes] = at, best
        run[off] = r


def _strings(data: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and starts of some of the strings, and where their bytes stand in ``data``."""
    sizes = starts[chosen + 1] - starts[chosen]
    new = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts[chosen] - new[:-1], sizes) + np.arange(new[-1])
    return data[at], new, at


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    size = high - low
    cut = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(low - cut[:-1], size) + np.arange(cut[-1])


def repeated_starts(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which bytes begin a string of ``length`` that also stands in an earlier string of the group.

    The strings of a group follow each other. Earlier halves of all groups are indexed, later
    halves streamed; then the halves are halved, until every two strings of a group have met.
    """
    out = np.zeros(len(data), bool)
    low = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    high = np.append(low[1:], len(group))
    while True:
        some = high - low > 1
        low, high = low[some], high[some]
        if not len(low):
            return out
        middle = (low + high + 1) // 2
        part = np.arange(len(low))
        index = RunIndex(*_strings(data, starts, _ranges(low, middle))[:2], np.repeat(part, middle - low))
        bytes_, begins, at = _strings(data, starts, _ranges(middle, high))
        out[at[index.matching_statistics(bytes_, begins, np.repeat(part, high - middle)) >= length]] = True
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        order = np.argsort(low)
        low, high = low[order], high[order]


# ---------------------------------------------------------------- contexts

def _anchor_counts(skip: np.ndarray | None, limit: int):
    """Counts of anchors; texts whose fingerprint is in ``skip`` are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(limit)
        for batch in batches:
            wanted = _wanted(batch, skip)
            for piece in pieces(batch.column("text"), PIECE):
                value, row, *_ = anchors(piece.data, piece.starts)
                counts.add(value[wanted[row + piece.first]])
                if counts.full():
                    yield from counts.take()
        yield from counts.take()
    return run


def _wanted(batch: pa.RecordBatch, skip: np.ndarray | None) -> np.ndarray:
    if skip is None:
        return np.ones(batch.num_rows, bool)
    return ~held_in([skip], batch.column("f1").to_numpy(zero_copy_only=False).view(np.uint64))


def _binary(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    at = _ranges(begin, end)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


_CONTEXT = ["key", "id", "f1", "place", "offset", "c", "bytes"]
_CONTEXT_TYPE = "key bigint, id bigint, f1 bigint, place bigint, offset bigint, c bigint, bytes binary"


def _contexts(often: np.ndarray, skip: np.ndarray | None):
    """The contexts of anchors that may occur twice. ``place`` packs start, number of strings and the text's tag."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = _wanted(batch, skip)
            ids, f1, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "f1", "tag"))
            for piece in pieces(batch.column("text"), PIECE):
                value, row, begin, count, offset = anchors(piece.data, piece.starts)
                some = np.flatnonzero(wanted[row + piece.first])
                some = some[held_in([often], value[some])]
                for k in range(0, len(some), STEP):
                    at = some[k:k + STEP]
                    start = piece.starts[row[at]] + begin[at]
                    end = start + count[at] - 1 + LENGTH
                    mine = row[at] + piece.first
                    c = _hashes(piece.data, start, end)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value[at].view(np.int64)), pa.array(ids[mine]), pa.array(f1[mine]),
                         pa.array((begin[at] << 23) | (count[at] << 16) | tag[mine]), pa.array(offset[at]),
                         pa.array(c.view(np.int64)), _binary(piece.data, start, end)], names=_CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(cut(batches))
    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of STEP rows or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STEP:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    low = int(begin.min())
    return span_hashes(data[low:int(end.max())], begin - low, end - low)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts cut by the anchor's place in the string; a part's key also holds the bytes all its strings share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = utf8(batch.column("bytes"))
        key, ids, f1, place, offset = (batch.column(c).to_numpy(zero_copy_only=False) for c in _CONTEXT[:5])
        begin, count, tag = place >> 23, (place >> 16) & 127, place & _TAG
        for low in range(0, LENGTH - GRAM + 1, PLACES):
            high = min(low + PLACES, LENGTH - GRAM + 1)
            first, last = np.maximum(0, offset - high + 1), np.minimum(count - 1, offset - low)
            rows = np.flatnonzero(first <= last)
            if not len(rows):
                continue
            first, last, base = first[rows], last[rows], at[:-1][rows]
            shared = _hashes(raw, base + offset[rows] - low, base + offset[rows] - high + 1 + LENGTH)
            own = mix(key[rows].view(np.uint64) ^ mix(shared + np.uint64(low)))
            start, end = base + first, base + last + LENGTH
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array(ids[rows]), pa.array(f1[rows]),
                 pa.array(((begin[rows] + first) << 23) | ((last - first + 1) << 16) | tag[rows]), pa.array(offset[rows] - first),
                 pa.array(_hashes(raw, start, end).view(np.int64)), _binary(raw, start, end)], names=_CONTEXT)


def _marks_of(place: Column) -> list[Column]:
    """tag, begin and end of a whole context."""
    begin = F.shiftright(place, 23)
    return [place.bitwiseAND(F.lit(_TAG)).alias("tag"), begin.alias("begin"),
            (begin + F.shiftright(place, 16).bitwiseAND(F.lit(127)) - 1 + LENGTH).alias("end")]


def _distinct(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of all contexts that equal an earlier one, and the other contexts of anchors with several
    classes, with the number of the anchor's classes in ``classes``."""
    contexts = contexts.withColumn("c2", F.xxhash64("bytes"))
    place = F.struct("id", "f1", "place")
    classes = contexts.groupBy("c", "c2").agg(F.min(place).alias("first"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes, "classes")
    copies = contexts.drop("bytes").join(classes.where("n > 1").select("c", "c2", "first"), ["c", "c2"]).where(place != F.col("first"))
    copies = copies.select("id", "f1", *_marks_of(F.col("place")))
    varied = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    chosen = classes.join(varied, "key").select("key", "first.*", "classes")
    return copies, contexts.drop("c", "c2").join(chosen, ["key", "id", "f1", "place"])


# ---------------------------------------------------------------- the index in tasks

def _block(key, ids, f1, places, raw, at) -> pa.RecordBatch:
    """Removed byte ranges of the contexts of some anchors, all of an anchor's contexts."""
    hit = repeated_starts(raw, at, key)
    begin = places >> 23
    on = np.flatnonzero(hit)
    string = np.searchsorted(at, on, "right") - 1
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (string[1:] != string[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(on))[:len(first)] - 1  # no string may have come up again
    own = string[first]
    columns = (ids[own], f1[own], places[own] & _TAG, begin[own] + on[first] - at[own], begin[own] + on[last] - at[own] + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=["id", "f1", "tag", "begin", "end"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted contexts, in blocks of whole anchors, through the index."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run(table: pa.Table) -> pa.RecordBatch:
        raw, at = utf8(table["bytes"])
        columns = [table[c].to_numpy() for c in ("key", "id", "f1", "place")]
        return _block(*columns, raw[at[0]:at[-1]], at - at[0])
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < BLOCK_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(cut[-1]) if len(cut) else 0
        bytes_at = utf8(table["bytes"])[1]
        begin = 0
        while begin < last:
            stop = int(np.searchsorted(bytes_at, bytes_at[begin] + BLOCK_BYTES, "right")) - 1
            whole = cut[(cut <= max(stop, begin + 1))]
            stop = int(whole[-1]) if len(whole) and whole[-1] > begin else int(cut[cut > begin][0])
            yield run(table.slice(begin, stop - begin))
            begin = stop
        held = table.slice(last).combine_chunks().to_batches()
        size = BLOCK_BYTES // 2 if len(cut) else 0  # one anchor goes on: gather more before looking again
    if held and sum(b.num_rows for b in held):
        yield run(pa.Table.from_batches(held).combine_chunks())


# ---------------------------------------------------------------- the operator

def _runs_of(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the maximal removed runs, as places in the batch's bytes and in their order."""
    none = np.zeros(0, np.int64)
    if "marks" not in batch.schema.names:
        return none, none, none
    lists = batch.column("marks")
    row, marks = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    begin, end = (pc.struct_field(marks, name).to_numpy(zero_copy_only=False) for name in ("begin", "end"))
    if not len(row):
        return none, none, none
    whole = begin < 0
    begin, end = at[row] + np.where(whole, 0, begin), np.where(whole, at[row + 1], at[row] + end)
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, (begin[1:] > end[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    return row[first], begin[first], end[np.append(first[1:], len(row)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of what is left of every text."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        row, begin, end = _runs_of(batch, at)
        rows = batch.num_rows
        removed, spans = np.zeros(rows, np.int64), np.bincount(row, minlength=rows)
        np.add.at(removed, row, end - begin)
        of = np.searchsorted(row, np.arange(rows + 1)).tolist()
        begins, ends, bounds, sha = begin.tolist(), end.tolist(), at.tolist(), []
        for k in range(rows):
            left, digest = bounds[k], hashlib.sha256()
            for run in range(of[k], of[k + 1]):
                digest.update(raw[left:begins[run]])
                left = ends[run]
            digest.update(raw[left:bounds[k + 1]])
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(spans.astype(np.int64)),
             pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(documents: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    f2 = F.xxhash64(F.lit(2), text)
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("id"), text.alias("text"),
                            F.xxhash64(text).alias("f1"), f2.alias("f2"), f2.bitwiseAND(F.lit(_TAG)).alias("tag"))


def _only(known: np.ndarray, inside: bool):
    """The rows whose fingerprint may be (or, turned round, is certainly not) in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = _wanted(batch, known) != inside
            for k in range(0, batch.num_rows, ROWS):
                if chosen[k:k + ROWS].any():
                    yield batch.slice(k, ROWS).filter(pa.array(chosen[k:k + ROWS]))
    return run


def _digests(marked: np.ndarray):
    """The digests of the texts that certainly have no marks, in the task that reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(_only(marked, False)(batches))
    return run


_ROW = "id bigint, f1 bigint, f2 bigint, tag bigint, text string"


def repeat_marks(documents: DataFrame) -> DataFrame:
    """(id, f1, tag, begin, end): removed byte ranges of a document; begin -1 stands for a whole text."""
    texts = _texts(documents).where(F.octet_length("text") >= LENGTH).select("id", "f1", "f2", "tag", "text")
    slim = settle(texts.drop("text"), "slim")
    same = slim.groupBy("f1", "f2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = settle(same.where("n > 1").drop("n"), "same")
    whole = F.lit(-1).cast("bigint")
    copies = slim.join(same, ["f1", "f2"]).where("id > first").select("id", "f1", "tag", whole.alias("begin"), whole.alias("end")).distinct()

    # Texts that stand once are read where they lie; of the others the first one is settled.
    twice = bitmap(same.select(F.col("f1").alias("key")))
    place = F.row_number().over(Window.partitionBy("f1", "f2").orderBy("id"))
    firsts = settle(texts.mapInArrow(_only(twice, True), _ROW).withColumn("place", place).where("place = 1").drop("place"), "firsts")

    def over(run, schema: str) -> DataFrame:
        return texts.mapInArrow(run(twice), schema).union(firsts.mapInArrow(run(None), schema))

    counts = over(lambda skip: _anchor_counts(skip, HELD), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    often = bitmap(settle(counts.where("n > 1").select("key"), "anchors"))
    contexts = settle(over(lambda skip: _contexts(often, skip), _CONTEXT_TYPE), "contexts")
    equal, rows = _distinct(contexts)
    rows = settle(rows, "distinct")
    crowded = rows.where(F.col("classes") > CROWDED).withColumn("c", F.lit(0).cast("bigint")).select(*_CONTEXT)
    parts = settle(crowded.mapInArrow(_by_place, _CONTEXT_TYPE), "parts")
    equal_parts, part_rows = _distinct(parts)
    columns = ["key", "id", "f1", "place", "bytes"]
    rows = rows.where(F.col("classes") <= CROWDED).select(*columns).union(part_rows.select(*columns))
    rows = rows.repartition("key").sortWithinPartitions("key", "id", "f1", "place")
    marks = rows.mapInArrow(_marked, "id bigint, f1 bigint, tag bigint, begin bigint, end bigint")
    return marks.union(equal).union(equal_parts).union(copies)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document row: bytes, removed bytes, removed runs, checksum of what is left."""
    texts = _texts(documents).select("doc_id", "id", "f1", "tag", "text")
    marks = repeat_marks(documents).groupBy("id", "f1", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    marks = settle(marks, "marks")
    # Only texts that may have marks are shuffled.
    marked = bitmap(marks.select(F.col("f1").alias("key")).distinct())
    row = "doc_id bigint, id bigint, f1 bigint, tag bigint, text string"
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    whole = texts.select("doc_id", "f1", "text").mapInArrow(_digests(marked), result)
    rest = texts.mapInArrow(_only(marked, True), row).join(marks, ["id", "f1", "tag"], "left").select("doc_id", "text", "marks")
    return whole.union(rest.mapInArrow(_cut, result))
