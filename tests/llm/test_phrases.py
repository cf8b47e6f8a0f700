"""Phrase mining against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetrisk.llm import phrases
from fleetrisk.llm.tables import reachable
from tests.llm.test_operators import ROWS, SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in (1, 2, 3):
                counts[lang].update(tuple(w[k:k + m]) for k in range(len(w) - m + 1))
    out = Counter()
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(2 * b >= a and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
                   for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out[lang, rank, p.decode(), -a, left, right, words[lang], -score] += 1
    return out


def corpus(seed, n):
    """Few words, so that many phrases repeat; separators, capitals, blanks and cuts of all kinds."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "são", "paulo", "z", "#1", "a\x1cb", "λόγος", "ÉT", "x-y", " n"] + [f"w{k}" for k in range(25)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words[:rng.choice((6, 20, 39))]) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!?", " \r\n", "\x0b"])
                       for _ in range(rng.randint(0, 60)))
        rows.append((k if k % 11 else None, text, rng.choice(["en", "en", "de", None, "und", "x y"])))
    rows += [rows[3]] * 12 + [(None, None, "en"), (5, "", "de"), (6, " \t", "only blank"), (7, "one", "one word")]
    return rows


@pytest.mark.parametrize("least, limit", [(10, phrases.HELD), (3, 40), (10, 40)])
def test_phrases_equal_brute_force(spark, least, limit):
    rows = corpus(least, 400)
    docs = reachable(spark).createDataFrame([(*r, 7, "p", "k") for r in rows],
                                            "doc_id bigint, text string, lang string, n int, phrase string, key string").repartition(3)
    got = Counter(map(tuple, phrases.collocations(docs, least, limit=limit).collect()))
    assert got == expected([r[1:] for r in rows], least) and got


def test_first_phrases_only(spark):
    rows = corpus(1, 80)
    docs = reachable(spark).createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert Counter(map(tuple, phrases.collocations(docs, 3, top=7).collect())) == expected([r[1:] for r in rows], 3, 7)


@pytest.mark.parametrize("share", [0, 1])
def test_result_does_not_depend_on_the_sample(spark, share):
    """Nothing proposed, so that all is border, and everything proposed."""
    rows = corpus(2, 100)
    docs = reachable(spark).createDataFrame(rows, "doc_id bigint, text string, lang string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    keys = phrases.frequent_keys(docs, F.lit(share) == 1, 10)
    found = {r.key for r in keys.collect()}
    usual = {r.key for r in phrases.frequent_keys(docs, F.pmod(F.xxhash64("text"), F.lit(4)) == 0, 10).collect()}
    assert found == usual and len(found) == keys.count()


def test_bitmaps_hold_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).union(spark.range(3).select((F.col("id") - 2).alias("key")))
    words = phrases.bitmap(keys)
    mine = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    assert phrases.held_in([words], mine).all()
    others = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert phrases.held_in([words], others).mean() < 0.2
    assert not phrases.held_in([phrases.bitmap(keys.limit(0))], mine).any()


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(999_999_999_999_989, 999_999_999_999_999, 1_234_567_890_123_456), (10, 11, 13), (3_037_000_500, 3_037_000_501, 3_037_000_503)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1000000 * a * a // (left * right) for a, left, right in rows]


def test_awkward_documents(spark):
    docs = reachable(spark).createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA)
    got = Counter(map(tuple, phrases.collocations(docs, 4).collect()))
    assert got == expected([(r[1], r[2]) for r in ROWS], 4)
    assert phrases.collocations(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "new York, of the " * 200_000, None)], "doc_id bigint, text string, lang string")
    assert Counter(map(tuple, phrases.collocations(long).collect())) == expected([("new York, of the " * 200_000, None)], 10)


def test_a_counting_task_keeps_to_its_memory():
    """6 MB of text in 2,000 rows, all of its words and pairs different."""
    numbers = np.random.default_rng(3).permutation(800_000) + 1_000_000
    texts = [" ".join(map(str, part)) for part in np.array_split(numbers, 2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in phrases._counting(phrases._words_and_pairs, phrases.HELD)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 800_000 + 800_000 - len(texts)
    assert peak < 115e6  # it took 128 MB with pieces of 2 MB and a table sorted anew at every step
