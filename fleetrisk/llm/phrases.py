"""Phrases that stand out in a language, mined by Toivonen's sampling.

A phrase can only be frequent if its parts are. So that not every phrase of the corpus has to
be counted:

* Sample. A share of the documents proposes frequent words and pairs, at a lowered bound.
* Full pass. All words, all pairs of proposed words and all triples of proposed pairs are
  counted over the whole corpus: the proposals and their negative border at once.
* Expansion. Where words or pairs of the border turn out to be frequent, a further pass counts
  what the first one could not: pairs with a newly frequent word, and triples that hold a
  newly frequent pair or a pair counted in this very pass. As the triples over all of that
  pass's pairs are counted with them, nothing is left open after it.
* Frequent phrases are then counted once more by their text.

Until then a phrase is a 64-bit key, whose lowest two bits are its number of words. Two
phrases with one key only make a count too high, so no frequent phrase is lost, and the last
count, by text, is exact. Proposals travel as bitmaps over the keys, of at most 16 MB each:
when they fill up, more phrases are counted than needed, with the same result. Every task adds
its counts up before they are shuffled, in tables of bounded size, so a phrase that stands
everywhere is one row per task.

Defined results. A NULL or empty text has no words. A NULL ``lang`` is ``und``, together with
rows that say ``und``. Repeated rows and rows without a doc_id count like any others. Phrases
with equal score and count are ranked by their UTF-8 bytes. A text of any length is read whole;
one text is in memory at a time, beside pieces of bounded size. Empty tables give no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.bitmaps import Counts, bitmap, held_in
from fleetrisk.llm.textbatch import MULTIPLIER, Piece, mix, pieces, span_hashes

WORDS = 3
LEAST = 10
TOP = 2000
#: A phrase is dropped for a longer one that has this percentage of its occurrences.
ABSORBED = 50
UNKNOWN = "und"
#: One in so many documents is in the sample.
SAMPLE = 4
#: Phrases whose counts a task holds before it hands them out, and bytes of text that it works on at once.
HELD, STEP_BYTES = 2_000_000, 1 << 18

CUTS = np.zeros(256, bool)
CUTS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
INSIDE = ~CUTS
INSIDE[[0x20, 0x09]] = False

_LEVEL = np.uint64(3)


# ---------------------------------------------------------------- the words of a piece

class Grams:
    """The words of a piece of texts and the phrases of up to three words they form.

    ``keys[m][k]`` is the key of the phrase of m words that starts at word k, and
    ``whole[m][k]`` tells whether these words stand in one piece of one text.
    """

    def __init__(self, piece: Piece, language: np.ndarray, longest: int = WORDS):
        w = self.words = piece.words(INSIDE, lower=True)
        count = len(w.begin)
        row = np.repeat(np.arange(len(piece)), np.diff(w.of))
        self.row = row
        hashes = mix(w.hashes() ^ language[row])
        cuts = np.concatenate([[0], np.cumsum(CUTS[w.data])])
        next_too = np.zeros(count, bool)
        if count:
            next_too[:-1] = (cuts[w.begin[1:]] == cuts[w.end[:-1]]) & (row[1:] == row[:-1])
        self.keys, self.whole = [None], [None]
        value, whole = hashes, np.ones(count, bool)
        for m in range(1, longest + 1):
            if m > 1:
                starts = max(0, count - m + 1)
                longer, whole = np.zeros(count, np.uint64), np.zeros(count, bool)
                longer[:starts] = value[:starts] * np.uint64(MULTIPLIER) + hashes[m - 1:]
                whole[:starts] = self.whole[m - 1][:starts] & next_too[m - 2:m - 2 + starts]
                value = longer
            self.keys.append(mix(value) & ~_LEVEL | np.uint64(m))
            self.whole.append(whole)


def _hash_of(languages: list[str]) -> np.ndarray:
    raw = [x.encode() for x in languages]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return mix(span_hashes(data, ends - [len(x) for x in raw], ends))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[Piece, np.ndarray, list[str]]]:
    """Pieces of the batch, each row's language by number, and the names of the languages."""
    coded = batch.column("lang").dictionary_encode()
    numbers, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    for piece in pieces(batch.column("text"), STEP_BYTES):
        yield piece, numbers[piece.first:piece.first + len(piece)], names


# ---------------------------------------------------------------- counting by key

def _outside(bitmaps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(~held_in(bitmaps, keys)))
    return run


def _counting(choose, limit: int):
    """Counts, by key, what ``choose(grams)`` picks from each piece."""
    longest = 2 if choose is _words_and_pairs else WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(limit)
        for batch in batches:
            for piece, numbers, names in _pieces(batch):
                for keys in choose(Grams(piece, _hash_of(names)[numbers], longest)):
                    counts.add(keys)
                    if counts.full():
                        yield from counts.take()
        yield from counts.take()
    return run


def _count(texts: DataFrame, choose, least: int, limit: int, name: str) -> DataFrame:
    """(key, n) of the chosen phrases with ``least`` or more occurrences.

    The tasks have added up already, so the rows are dealt first and added up only once more.
    """
    rows = texts.mapInArrow(_counting(choose, limit), "key bigint, n bigint").repartition("key")
    return settle(rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


def _words_and_pairs(grams: Grams) -> Iterator[np.ndarray]:
    yield grams.keys[1]
    yield grams.keys[2][grams.whole[2]]


def _proposed_and_border(words: list[np.ndarray], pairs: list[np.ndarray]):
    """All words, the pairs of proposed words, the triples of proposed pairs."""
    def choose(grams: Grams) -> Iterator[np.ndarray]:
        yield grams.keys[1]
        known = held_in(words, grams.keys[1])
        at = np.flatnonzero(grams.whole[2])
        at = at[known[at] & known[at + 1]]
        yield grams.keys[2][at]
        known[:] = False
        known[at] = held_in(pairs, grams.keys[2][at])
        at = np.flatnonzero(grams.whole[3])
        yield grams.keys[3][at[known[at] & known[at + 1]]]
    return choose


def _expansion(words: list[np.ndarray], more_words: list[np.ndarray], pairs: list[np.ndarray], more_pairs: list[np.ndarray]):
    """What the full pass did not count: pairs with a word of ``more_words``, and triples that hold
    such a pair or one of ``more_pairs``."""
    def choose(grams: Grams) -> Iterator[np.ndarray]:
        old = held_in(words, grams.keys[1])
        known = old | held_in(more_words, grams.keys[1])
        at = np.flatnonzero(grams.whole[2])
        at = at[known[at] & known[at + 1]]
        before = old[at] & old[at + 1]  # the full pass has counted this pair
        new = at[~before]
        yield grams.keys[2][new]
        counted = np.zeros(len(old), bool)  # proposed in the full pass
        live = np.zeros(len(old), bool)
        live[new] = True
        at = at[before]
        counted[at] = held_in(pairs, grams.keys[2][at])
        live[at] = counted[at] | held_in(more_pairs, grams.keys[2][at])
        at = np.flatnonzero(grams.whole[3])
        at = at[live[at] & live[at + 1]]
        yield grams.keys[3][at[~(counted[at] & counted[at + 1])]]
    return choose


def _level(table: DataFrame, words: int) -> DataFrame:
    return table.where(F.col("key").bitwiseAND(F.lit(3)) == words).select("key")


def frequent_keys(texts: DataFrame, sample: Column, least: int = LEAST, limit: int = HELD) -> DataFrame:
    """The keys of all phrases with ``least`` or more occurrences, by sample, full pass and expansion."""
    lowered = max(2, least * 4 // (5 * SAMPLE))
    proposed = _count(texts.where(sample), _words_and_pairs, lowered, limit, "proposed")
    words, pairs = [bitmap(_level(proposed, 1))], [bitmap(_level(proposed, 2))]
    found = _count(texts, _proposed_and_border(words, pairs), least, limit, "frequent")
    missed = [_level(found, m).mapInArrow(_outside(known), "key bigint") for m, known in ((1, words), (2, pairs))]
    missed = [settle(keys, "missed") for keys in missed]
    if all(keys.isEmpty() for keys in missed):
        return found
    more = _expansion(words, [bitmap(missed[0])], pairs, [bitmap(missed[1])])
    return found.union(_count(texts, more, least, limit, "frequent"))


# ---------------------------------------------------------------- counting by text

class Spelled:
    """Counts of frequent phrases with their spelling, in a table of bounded size."""

    def __init__(self):
        self.keys, self.counts, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.langs: list[np.ndarray] = []
        self.texts: list[pa.Array] = []
        self.rows = 0

    def add(self, grams: Grams, starts: list[np.ndarray], language: np.ndarray) -> None:
        """Counts phrases that start at some words; ``starts[m - 1]`` are those of m words."""
        keys = np.concatenate([grams.keys[m][at] for m, at in enumerate(starts, 1)])
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        self.counts[place[known]] += counts[known]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        # One length of phrases after the other, as their texts are made together.
        begin = np.concatenate(starts)[first[new]]
        words = (keys[new] & _LEVEL).astype(np.int64)
        order = np.argsort(words, kind="stable")
        for m in range(1, WORDS + 1):
            mine = begin[words == m]
            if len(mine):
                self.texts.append(_spelling(grams, mine, m))
        self.langs.append(language[grams.row[begin[order]]])
        at = np.empty(len(new), np.int64)
        at[order] = np.arange(self.rows, self.rows + len(new))
        self.rows += len(new)
        place = place[new]
        self.keys, self.counts = np.insert(self.keys, place, keys[new]), np.insert(self.counts, place, counts[new])
        self.at = np.insert(self.at, place, at)

    def take(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.rows:
            texts, langs = pa.concat_arrays(self.texts), np.concatenate(self.langs)
            names = pa.array(names, pa.string())
            for k in range(0, len(self.keys), 100_000):
                at = self.at[k:k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(langs[at])), texts.take(pa.array(at)).cast(pa.string()),
                     pa.array((self.keys[k:k + 100_000] & _LEVEL).astype(np.int32)), pa.array(self.counts[k:k + 100_000])],
                    names=["lang", "phrase", "words", "a"])
        self.__init__()


def _spelling(grams: Grams, starts: np.ndarray, m: int) -> pa.Array:
    """The phrases of m words at some words, their words joined by single spaces."""
    w = grams.words
    at = (starts[:, None] + np.arange(m)).ravel()
    size = w.end[at] - w.begin[at] + 1  # with a space after each word
    cut = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(w.begin[at] - cut[:-1], size) + np.arange(cut[-1])
    data = w.data[np.minimum(source, len(w.data) - 1)]
    data[cut[1:] - 1] = 0x20
    last = cut[1:][m - 1::m] - 1  # the space after each phrase goes
    keep = np.ones(len(data), bool)
    keep[last] = False
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(size, np.arange(0, len(size), m)) - 1)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))


def _spell(bitmaps: list[np.ndarray], limit: int):
    """(lang, phrase, words, a) of phrases in the bitmaps; rows of 0 words count all words of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, number, total = Spelled(), {}, []
        for batch in batches:
            for piece, numbers, names in _pieces(batch):
                for name in names:
                    if name not in number:
                        number[name] = len(number)
                        total.append(0)
                language = np.array([number[n] for n in names], np.int64)[numbers]
                grams = Grams(piece, _hash_of(names)[numbers])
                for lang, count in enumerate(np.bincount(language[grams.row], minlength=1).tolist()):
                    total[lang] += count
                starts = [np.flatnonzero(grams.whole[m]) for m in range(1, WORDS + 1)]
                spelled.add(grams, [at[held_in([bitmaps[m - 1]], grams.keys[m][at])] for m, at in enumerate(starts, 1)], language)
                if spelled.rows >= limit:
                    yield from spelled.take(list(number))
        yield from spelled.take(list(number))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(number), pa.string()), pa.array([""] * len(number), pa.string()),
             pa.array([0] * len(number), pa.int32()), pa.array(total, pa.int64())], names=["lang", "phrase", "words", "a"])
    return run


# ---------------------------------------------------------------- scores and ranks

def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10^16."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1000000).cast("decimal(7,0)"), wide[1] * wide[2])


def _scored(counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): every candidate at its lowest cut."""
    words = F.split("phrase", " ")
    cuts = counts.where((F.col("words") > 1) & (F.col("a") >= least))
    cuts = cuts.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(words, F.col("cut") + 1, F.col("words")), " "))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.join(part, ["lang", side])
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("low")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(lowest)
    return best.select("lang", "phrase", "words", "a", "low.l", "low.r", "low.score")


def _not_absorbed(candidates: DataFrame) -> DataFrame:
    """Candidates without those that mostly stand inside a longer candidate."""
    words = F.split("phrase", " ")
    longer = candidates.where(F.col("words") > 2)
    spans = F.array(*[F.struct(F.lit(k).alias("from"), F.lit(m).alias("size")) for m in range(2, WORDS) for k in range(1, WORDS)])
    inside = longer.select("lang", "a", "words", "phrase", F.explode(spans).alias("span"))
    inside = inside.where("span.size < words and span.from + span.size - 1 <= words")
    part = F.array_join(F.slice(words, F.col("span.from"), F.col("span.size")), " ")
    inside = inside.select("lang", part.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(100 * F.col("longer") < ABSORBED * F.col("a"), F.lit(True))).drop("longer")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, limit: int = HELD) -> DataFrame:
    """The first ``top`` phrases of two or three words per language, by score."""
    text = F.col("text").cast("string")
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"),
                             F.xxhash64(F.col("doc_id").cast("string"), text).alias("draw"))
    sample = F.pmod(F.col("draw"), F.lit(SAMPLE)) == 0
    keys = frequent_keys(texts, sample, least, limit)
    bitmaps = [bitmap(_level(keys, m)) for m in range(1, WORDS + 1)]
    counts = (texts.select("lang", "text").mapInArrow(_spell(bitmaps, limit // 2), "lang string, phrase string, words int, a bigint")
              .repartition("lang", "phrase").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")))
    counts = settle(counts.where((F.col("a") >= least) | (F.col("words") == 0)), "phrases")
    candidates = _not_absorbed(settle(_scored(counts, least), "candidates"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("a").alias("n"))  # one row per language
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
