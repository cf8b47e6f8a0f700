"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the vector of its letter n-grams (bytes of the lower-cased text, hashed into a
fixed number of dimensions), weighed by inverse document frequency and brought to length 1.
Every language has several centroids, found by spherical k-means over a sample of its
documents; the prediction is the language of the centroid with the largest cosine. A text
that lies further from its centroid than the texts it was learned from is marked as
rejected; the nearest language is still named, so the caller decides what rejection means.

The fit uses at most ``SAMPLE`` different documents of each language (the lowest hashes of id and text); the
centroids of a language are found in one task of that bounded size, languages in parallel.
Whole texts are read for learning and for prediction.

Defined results. NULL texts and texts without a letter get ``und`` with score 0 and are
rejected. Documents without a language teach nothing but are predicted. If there is nothing
to learn from, every text is ``und``. Ties go to the language first in order. Repeated rows
are predicted alike. A text of any length is read whole; one text is in memory at a time, beside
pieces of bounded size. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.bitmaps import bitmap, held_in
from fleetrisk.llm.textbatch import Piece, lists, mix, pieces

DIMENSIONS = 4096
SAMPLE = 600
CENTROIDS = 4
ROUNDS = 8
SIZES = (1, 2, 3)
#: Rows whose vectors are held at once.
ROWS = 256
#: A text is rejected below this share of the learned texts' cosines, less a margin.
REJECT_SHARE = 0.005
REJECT_MARGIN = 0.05
UNKNOWN = "und"

#: Letters stand for themselves (beyond ASCII every byte does); all else is one separator.
LETTER = np.full(256, 0x20, np.uint8)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)


def counts(piece: Piece, begin: int, end: int) -> np.ndarray:
    """Rows x dimensions: n-gram counts of rows begin..end of a lower-cased piece."""
    starts = piece.starts[begin:end + 1]
    data = LETTER[piece.data[starts[0]:starts[-1]]].astype(np.uint64)
    row = np.repeat(np.arange(end - begin), np.diff(starts))
    total = np.zeros((end - begin) * DIMENSIONS, np.float32)
    value = np.zeros(len(data), np.uint64)
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            break
        value = (value[:m] << np.uint64(8)) | data[n - 1:]
        inside = (row[:m] == row[n - 1:]) & ((data[:m] != 0x20) | (data[n - 1:] != 0x20))
        key = (mix(value + np.uint64(n << 40)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
        at = (row[:m] * DIMENSIONS + key)[inside]
        total += np.bincount(at, minlength=len(total)).astype(np.float32)
    return total.reshape(-1, DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; an empty row stays empty."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _bucket(modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, at, n): the n-gram counts of a text, without the zeros."""
    for batch in batches:
        for piece in pieces(pc.utf8_lower(batch.column("text"))):
            for begin in range(0, len(piece), ROWS):
                end = min(begin + ROWS, len(piece))
                rows = counts(piece, begin, end)
                r, at = np.nonzero(rows)
                offsets = np.searchsorted(r, np.arange(end - begin + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(piece.first + begin, end - begin),
                     lists(at, offsets, pa.int32()), lists(rows[r, at], offsets, pa.float32())], names=["lang", "at", "n"])


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means (started far apart) and the least usual cosine of each."""
    chosen = [unit(vectors.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[np.argmin((vectors @ np.array(chosen).T).max(axis=1))])
    centroids = np.array(chosen)
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        centroids = np.array([unit(vectors[nearest == c].mean(axis=0, keepdims=True))[0] if (nearest == c).any()
                              else centroids[c] for c in range(len(centroids))])
    cosine = vectors @ centroids.T
    nearest = cosine.argmax(axis=1)
    usual = np.quantile(cosine.max(axis=1), REJECT_SHARE)
    least = [np.quantile(cosine[nearest == c, c], REJECT_SHARE) if (nearest == c).sum() > 20 else usual
             for c in range(len(centroids))]
    return centroids, np.array(least) - REJECT_MARGIN


class Model:
    """Inverse document frequencies and the centroids of all languages."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, np.array(langs, object), centroids, least

    def predict(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for piece in pieces(pc.utf8_lower(texts)):
            for begin in range(0, len(piece), ROWS):
                end = min(begin + ROWS, len(piece))
                own = slice(piece.first + begin, piece.first + end)
                if not len(self.langs):
                    names += [UNKNOWN] * (end - begin)
                    continue
                cosine = unit(counts(piece, begin, end) * self.idf) @ self.centroids.T
                best = cosine.argmax(axis=1)
                value = np.clip(cosine[np.arange(end - begin), best], 0, 1)
                known = letters[own]
                score[own] = np.where(known, value, 0)
                rejected[own] = ~known | (value < self.least[best])
                names += np.where(known, self.langs[best], UNKNOWN).tolist()
        return names, score, rejected


def _may_be_drawn(draws: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held_in([draws], batch.column("draw").to_numpy(zero_copy_only=False).view(np.uint64))))
    return run


def drawn_rows(documents: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of ``sample`` different documents of each language, all where it has fewer.

    The draw is a hash of doc_id and text, and the lowest ones are taken: no more than ``sample``
    for ids that repeat or are NULL, and the same ones in every run. Only hashes are ranked; a
    bitmap of the chosen ones picks the texts, so no others are shuffled.
    """
    draw = F.xxhash64(F.lit("sample"), "doc_id", "text")
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", draw.alias("draw"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = known.select("lang", "draw").distinct().withColumn("place", place).where(F.col("place") <= sample).drop("place")
    chosen = settle(chosen, "drawn")
    draws = bitmap(chosen.select(F.col("draw").alias("key")))
    picked = known.mapInArrow(_may_be_drawn(draws), "lang string, text string, draw bigint")
    return picked.join(chosen, ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("lang", "text")


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``documents`` (text, lang, doc_id): at most ``sample`` of each language."""
    drawn = drawn_rows(documents, sample)
    vectors = settle(drawn.mapInArrow(_vectors, "lang string, at array<int>, n array<float>"), "vectors")
    rows = vectors.count()
    seen = vectors.select(F.explode("at").alias("at")).groupBy("at").count().toArrow()
    df = np.zeros(DIMENSIONS)
    df[seen["at"].to_numpy()] = seen["count"].to_numpy()
    idf = (np.log((1 + rows) / (1 + df)) + 0.1).astype(np.float32)

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), DIMENSIONS), np.float32)
        for k, (at, n) in enumerate(zip(group["at"], group["n"])):
            dense[k, at] = n
        found, least = cluster(unit(dense * idf))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "vector": [c.astype(float).tolist() for c in found], "least": least})
    learned = (vectors.groupBy("lang").applyInPandas(centroids, "lang string, vector array<double>, least double")
               .orderBy("lang", "vector").collect())
    matrix = np.array([r.vector for r in learned], np.float32).reshape(len(learned), DIMENSIONS)
    return Model(idf, [r.lang for r in learned], matrix, np.array([r.least for r in learned]))


def identify(documents: DataFrame, modulus: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Per document row: held out from learning, language, cosine, rejected."""
    frame = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                             F.col("lang").cast("string").alias("lang"))
    frame = frame.withColumn("held_out", _bucket(modulus) == held_out)
    model = fit(frame.where(~F.col("held_out")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
    return frame.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
