"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The bracket is the sum-of-squares identity: it equals the sum of all pairwise interactions
<v_i, v_j> x_i x_j, at a cost linear in the number of features that are not zero.

Features are the text's words hashed into ``BUCKETS`` dimensions (square roots of their
shares), structure statistics of the text, and its recorded length (n_chars). Labels,
language, source and id are never features.

The fit uses at most ``SAMPLE`` labelled documents (the lowest hashes of the id). They are dealt
over ``PARTS`` tasks; in every round each task descends from the shared parameters over its
part, and the parameters, of fixed size, are averaged.

Defined results. NULL and empty texts have no words and zero statistics, and get the score
that follows from that. Without labels every score is 0.5. Labels: rows without id or
quality are left out; several labels of one id are averaged and rounded. Repeated document
rows are scored alike; the fit takes one document of an id. A text of any length is read whole;
one text is in memory at a time, beside pieces of bounded size. An empty table gives no rows.
Other columns are not read; a table without n_chars counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.quality import Measures, per_row
from fleetrisk.llm.textbatch import LOWER, Piece, lists, pieces, span_hashes

BUCKETS = 1 << 12
FACTORS = 4
SAMPLE = 16_000
PARTS = 8
ROUNDS = 6
EPOCHS = 2
BATCH = 64
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.3
SEED = 7

STATISTICS = ("one", "log_words", "mean_word", "symbols", "upper", "digits", "newlines", "repeated", "dup_lines",
              "bangs", "bars", "non_ascii", "distinct", "log_recorded")
WIDTH = BUCKETS + len(STATISTICS)


def _share(byte_set: np.ndarray, piece: Piece, size: np.ndarray) -> np.ndarray:
    return per_row(byte_set[piece.data], piece.starts) / size


def _set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _DIGIT, _LINE = _set(range(0x41, 0x5B)), _set(range(0x30, 0x3A)), _set([0x0A])
_BANG, _BAR, _WIDE = _set(b"!?"), _set(b"|"), _set(range(0xC0, 0x100))


def features(piece: Piece, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, index, value) of the rows' features that are not zero."""
    m = Measures(piece)
    rows = len(piece)
    size = np.maximum(np.diff(piece.starts), 1)
    words = np.maximum(m.n_words, 1)
    lines = per_row(piece.data == 0x0A, piece.starts) + 1
    # The words of the lower-cased text stand at the same places.
    bucket = (span_hashes(LOWER[piece.data], m.words.begin, m.words.end) & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, count = np.unique(m.row_of_word * BUCKETS + bucket, return_counts=True)
    row = key // BUCKETS
    value = np.sqrt(count / words[row])
    distinct = np.bincount(row, minlength=rows)[:rows] / words
    stats = np.stack([
        np.ones(rows), np.log1p(m.n_words) / 8, m.word_chars / words / 10, np.minimum(5 * m.n_symbols / size, 1),
        _share(_UPPER, piece, size), _share(_DIGIT, piece, size), np.minimum(10 * _share(_LINE, piece, size), 1),
        m.n_repeat_words / words, m.n_dup_lines / lines, np.minimum(5 * _share(_BANG, piece, size), 1),
        np.minimum(5 * _share(_BAR, piece, size), 1), _share(_WIDE, piece, size), distinct,
        np.log1p(np.maximum(recorded, 0)) / 10], axis=1)
    per = np.bincount(row, minlength=rows)[:rows] + len(STATISTICS)
    offsets = np.concatenate([[0], np.cumsum(per)])
    index, values = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.float32)
    place = np.arange(len(key)) + row * len(STATISTICS)
    index[place], values[place] = key % BUCKETS, value
    tail = offsets[1:, None] - len(STATISTICS) + np.arange(len(STATISTICS))
    index[tail], values[tail] = BUCKETS + np.arange(len(STATISTICS)), stats
    return offsets, index, values


class Machine:
    """Parameters of the factorisation machine."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    @staticmethod
    def fresh() -> Machine:
        rng = np.random.default_rng(SEED)
        return Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, FACTORS)))

    def margin(self, offsets, index, value) -> np.ndarray:
        """The machine's value for every row, in time linear in its features."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        total = self.bias + np.bincount(row, self.weight[index] * value, len(offsets) - 1)
        for f in range(self.factor.shape[1]):
            x = self.factor[index, f] * value
            total += (np.bincount(row, x, len(offsets) - 1) ** 2 - np.bincount(row, x * x, len(offsets) - 1)) / 2
        return total

    def descend(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int) -> None:
        """``EPOCHS`` passes of AdaGrad over the rows in small batches."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                index = np.concatenate([rows[k][0] for k in chosen])
                value = np.concatenate([rows[k][1] for k in chosen]).astype(float)
                offsets = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in chosen])])
                row = np.repeat(np.arange(len(chosen)), np.diff(offsets))
                error = (1 / (1 + np.exp(-np.clip(self.margin(offsets, index, value), -30, 30))) - labels[chosen]) / len(chosen)
                v = self.factor[index]
                sums = np.stack([np.bincount(row, v[:, f] * value, len(chosen)) for f in range(FACTORS)], axis=1)
                e = error[row] * value
                touched, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, e) + DECAY * self.weight[touched]
                dv = np.stack([np.bincount(place, e * (sums[row, f] - v[:, f] * value)) for f in range(FACTORS)], axis=1)
                dv += DECAY * self.factor[touched]
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                gb += error.sum() ** 2
                self.weight[touched] -= RATE * dw / np.sqrt(gw[touched])
                self.factor[touched] -= RATE * dv / np.sqrt(gv[touched])
                self.bias -= RATE * error.sum() / np.sqrt(gb)


def _prepared(documents: DataFrame) -> DataFrame:
    recorded = F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(0.0)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            F.coalesce(recorded, F.lit(0.0)).alias("recorded"))


def _each(batch: pa.RecordBatch):
    recorded = batch.column("recorded").to_numpy(zero_copy_only=False)
    for piece in pieces(batch.column("text")):
        yield piece, features(piece, recorded[piece.first:piece.first + len(piece)])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, (offsets, index, value) in _each(batch):
            part = batch.slice(piece.first, len(piece))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), lists(index, offsets, pa.int32()), lists(value, offsets, pa.float32())],
                names=["doc_id", "label", "at", "x"])


def _held_out(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 0


def fit(documents: DataFrame, labels: DataFrame, modulus: int, sample: int = SAMPLE) -> Machine | None:
    """A machine learned from at most ``sample`` labelled documents outside the held-out part.

    The ids with the lowest hashes are drawn; of several documents of one id, the one whose text
    has the lowest hash is taken.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
             .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~_held_out(modulus)))
    each = known.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("label"))
    drawn = settle(each.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample), "drawn")
    if drawn.isEmpty():
        return None
    # At most ``sample`` rows of two numbers, so they may go to every task.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    rows = _prepared(documents).join(F.broadcast(drawn), "doc_id").withColumn("place", place).where("place = 1").drop("place")
    taken = settle(rows.mapInArrow(_sampled, "doc_id bigint, label double, at array<int>, x array<float>")
                   .repartition(PARTS, "doc_id"), "sample")
    machine = Machine.fresh()
    for turn in range(ROUNDS):
        def descend(batches: Iterator[pa.RecordBatch], start=machine, turn=turn) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:  # a part may get no rows
                return
            table = pa.Table.from_batches(held).sort_by("doc_id")
            rows = list(zip(map(np.asarray, table["at"].to_pylist()), map(np.asarray, table["x"].to_pylist())))
            own = Machine(start.bias, start.weight.copy(), start.factor.copy())
            own.descend(rows, table["label"].to_numpy(), SEED + turn)
            flat = np.concatenate([[own.bias], own.weight, own.factor.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([table["doc_id"][0].as_py()]), pa.array([len(rows)], pa.int64()),
                                              lists(flat, np.array([0, len(flat)]), pa.float64())], names=["first", "n", "flat"])
        parts = taken.repartition(PARTS, "doc_id").mapInArrow(descend, "first bigint, n bigint, flat array<double>").collect()
        if not parts:
            return None
        parts = sorted(parts, key=lambda p: p.first)
        flat = np.average([p.flat for p in parts], axis=0, weights=[p.n for p in parts])
        machine = Machine(float(flat[0]), flat[1:WIDTH + 1], flat[WIDTH + 1:].reshape(WIDTH, FACTORS))
    return machine


def score_documents(documents: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Per document row: held out from learning, score of good quality, prediction."""
    machine = fit(documents, labels, modulus, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, (offsets, index, value) in _each(batch):
                part = batch.slice(piece.first, len(piece))
                margin = np.zeros(len(piece)) if machine is None else machine.margin(offsets, index, value.astype(float))
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return (_prepared(documents).withColumn("held_out", _held_out(modulus))
            .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"))
