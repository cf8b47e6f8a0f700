"""Quality rules: base counts of a text and its divergence from language references.

A reference holds, for one language, the shares of character classes and of the most common
words. A text is compared with every reference by Jensen-Shannon distance and keeps the
smallest one; a text that is far from all languages is rejected. Short texts have noisy
histograms, so each comparison has a least length below which it says nothing.

References are counted over all documents that have a language and pass the base rules.
Words are counted exactly: a task hands its counts on whenever it holds ``HELD_WORDS`` of
them, and they are summed by language and word. Every language with ``LEAST_REFERENCE`` such
words gets a reference, whatever else the table holds; documents of a language with fewer are
judged by the base rules alone. The references stand on the driver and in every task.

Defined results. NULL, empty and blank texts have no words and fail the base rules. Without
any reference (empty table, no languages) the base rules alone decide. Rows without a language
are held against all references. Repeated rows are judged alike, row by row. Columns other than doc_id, text and lang are never read by the
measures; the filter hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.textbatch import NOT_SPACE, SPACE, Piece, Words, mix, pieces, span_hashes, window_hashes

LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
COMMON_WORDS = 100
#: Words of a language that a reference needs.
LEAST_REFERENCE = 1000
#: Counts that a task holds before it hands them on.
HELD_WORDS = 1 << 19
#: Least length for the comparison of character classes (bytes) and of common words.
LEAST_CHARS = 400
LEAST_COMMON_TEXT = 50
#: Largest distance (square root of the divergence, base 2) that a kept text may have.
MOST_CHAR_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: Character classes by byte; a code point beyond ASCII counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "punctuation", "symbol", "control", "latin", "other")
CLASS = np.full(256, 6, np.int64)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A] = 0, 1, 2
CLASS[0:0x20], CLASS[0x7F] = 8, 8
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
CLASS[0x0A] = 4
CLASS[list(b".,;:?")] = 5
CLASS[list(b"#*$%&|<>@^_~`+=\\/{}[]")] = 7
CLASS[0xC2:0xCE] = 9
CLASS[0xCE:] = 10
CLASS[0x80:0xC0] = len(CLASSES)

_COUNTS = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint, base_failed boolean, char_distance double, word_distance double, kept boolean")


def per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does it occur twice or more, and is it not the first one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


class Measures:
    """The base counts of the rows of a piece."""

    def __init__(self, piece: Piece):
        data, starts, rows = piece.data, piece.starts, len(piece)
        self.words: Words = piece.words(NOT_SPACE)
        w = self.words
        self.hashes = w.hashes()
        self.n_words = np.diff(w.of)
        inside = NOT_SPACE[data]
        self.word_chars = per_row(inside & ((data & 0xC0) != 0x80), starts)
        self.n_symbols = per_row(SYMBOL[data], starts)
        row_of_word = np.repeat(np.arange(rows), self.n_words)

        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        cut[1:][data == 0x0A] = True
        begin = np.flatnonzero(cut[:-1])
        end = np.append(begin[1:], len(data))
        end = end - ((end > begin) & (data[end - 1] == 0x0A)) if len(data) else end
        words_before = np.concatenate([[0], np.cumsum(inside)])
        full = words_before[end] > words_before[begin]
        begin, end = begin[full], end[full]
        row_of_line = np.searchsorted(starts, begin, "right") - 1
        key = mix(span_hashes(data, begin, end) ^ mix(row_of_line.astype(np.uint64) + np.uint64(1)))
        self.n_dup_lines = np.bincount(row_of_line[repeated(key)[1]], minlength=rows)[:rows]

        windows = window_hashes(self.hashes, WINDOW)
        cover = np.zeros(len(self.hashes) + 1, np.int64)
        if len(windows):
            own = row_of_word[:len(windows)]
            whole = np.flatnonzero(own == row_of_word[WINDOW - 1:])
            key = mix(windows[whole] ^ mix(own[whole].astype(np.uint64) + np.uint64(1)))
            hit = whole[repeated(key)[0]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
        self.n_repeat_words = per_row(np.cumsum(cover[:-1]) > 0, w.of)
        self.failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words)
        self.row_of_word = row_of_word

    def classes(self, piece: Piece) -> np.ndarray:
        """Rows x classes: code points of each class."""
        n, k = len(piece), len(CLASSES) + 1
        row = np.repeat(np.arange(n) * k, np.diff(piece.starts))
        return np.bincount(row + CLASS[piece.data], minlength=n * k).reshape(n, k)[:, :-1]


def distance(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) between each row's shares and ``share``."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(share > 0, share * np.log2(share / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


_KINDS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def _counts(lang: str, kind: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(kind, pa.string()), n),
                                       pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], schema=_KINDS)


def _summed(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The held word counts, one row per language and word."""
    for lang, parts in held.items():
        value, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        count = np.zeros(len(value), np.int64)
        np.add.at(count, at, np.concatenate([c for _, c in parts]))
        yield _counts(lang, "word", value.view(np.int64), count)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: character classes and words of the task's documents; a word may come in several rows."""
    classes: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        langs = batch.column("lang")
        for piece in pieces(batch.column("text")):
            part = langs.slice(piece.first, len(piece)).dictionary_encode()
            code = np.asarray(part.indices.fill_null(-1))
            m = Measures(piece)
            by_class = m.classes(piece)
            code = np.where(m.failed, -1, code)
            of_word = code[m.row_of_word]
            for k, lang in enumerate(part.dictionary.to_pylist()):
                words = m.hashes[of_word == k]
                if not len(words):
                    continue
                classes[lang] = classes.get(lang, 0) + by_class[code == k].sum(axis=0)
                seen[lang] = seen.get(lang, 0) + len(words)
                held.setdefault(lang, []).append(np.unique(words, return_counts=True))
                size += len(held[lang][-1][0])
            if size > HELD_WORDS:
                yield from _summed(held)
                held, size = {}, 0
    yield from _summed(held)
    for lang, by_class in classes.items():
        yield _counts(lang, "all", np.zeros(1, np.int64), np.array([seen[lang]]))
        yield _counts(lang, "class", np.arange(len(CLASSES)), by_class)


def references(documents: DataFrame) -> DataFrame:
    """(lang, kind, key, n): words in all, characters per class, the most common words."""
    counts = (documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
              .mapInArrow(_count, "lang string, kind string, key bigint, n bigint")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    # The other kinds have fewer rows than that; a bound on the rank alone is kept to before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).drop("rank")


class Reference:
    """The references as arrays."""

    def __init__(self, rows: list):
        table: dict[str, dict[str, list]] = {}
        for lang, kind, key, n in rows:
            table.setdefault(lang, {}).setdefault(kind, []).append((key, n))
        self.langs, self.classes, self.words = [], [], []
        for lang in sorted(table):
            n_words = table[lang]["all"][0][1]
            if n_words < LEAST_REFERENCE:
                continue
            self.langs.append(lang)
            by_class = np.zeros(len(CLASSES))
            for key, n in table[lang]["class"]:
                by_class[key] = n
            self.classes.append(by_class / max(by_class.sum(), 1))
            pairs = sorted(table[lang].get("word", []))
            value = np.array([k for k, _ in pairs], np.int64).view(np.uint64)
            share = np.array([n for _, n in pairs], float) / n_words
            order = np.argsort(value)
            self.words.append((value[order], np.append(share[order], max(0.0, 1 - share.sum()))))

    def distances(self, piece: Piece, m: Measures) -> tuple[np.ndarray, np.ndarray]:
        """Smallest distance of every row to a language, by characters and by words."""
        rows = len(piece)
        by_class = m.classes(piece)
        chars, words = np.ones(rows), np.ones(rows)
        for share in self.classes:
            chars = np.minimum(chars, distance(by_class, share))
        for value, share in self.words:
            k = len(share)
            at = np.full(len(m.hashes), k - 1)
            if len(value):
                near = np.minimum(np.searchsorted(value, m.hashes), len(value) - 1)
                at = np.where(value[near] == m.hashes, near, k - 1)
            counts = np.bincount(m.row_of_word * k + at, minlength=rows * k).reshape(rows, k)
            words = np.minimum(words, distance(counts, share))
        return chars, words

    def verdict(self, piece: Piece, m: Measures, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and whether the row is kept; ``langs`` are those of the piece's batch."""
        if not self.classes:
            none = np.zeros(len(piece))
            return none, none, ~m.failed
        chars, words = self.distances(piece, m)
        odd = (np.diff(piece.starts) >= LEAST_CHARS) & (chars > MOST_CHAR_DISTANCE)
        odd |= (m.n_words >= LEAST_COMMON_TEXT) & (words > MOST_WORD_DISTANCE)
        own = langs.slice(piece.first, len(piece)).cast(pa.string())
        known = pc.or_(pc.is_null(own), pc.is_in(own, pa.array(self.langs, pa.string()))).to_numpy(zero_copy_only=False)
        return chars, words, ~m.failed & ~(odd & known)


def measure(documents: DataFrame) -> DataFrame:
    """Per document row: base counts, distances to the nearest reference, verdict."""
    reference = Reference(references(documents).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                m = Measures(piece)
                chars, words, kept = reference.verdict(piece, m, batch.column("lang"))
                columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.first, len(piece)), *[pa.array(c, pa.int64()) for c in columns],
                     *map(pa.array, (m.failed, chars, words, kept))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "char_distance", "word_distance", "kept"])
    frame = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                             F.col("lang").cast("string").alias("lang"))
    return frame.mapInArrow(run, _COUNTS)


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, as they are, that the rules keep."""
    reference = Reference(references(documents).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                kept = reference.verdict(piece, Measures(piece), batch.column("lang"))[2]
                yield batch.slice(piece.first, len(piece)).filter(pa.array(kept))
    return documents.mapInArrow(run, documents.schema)
