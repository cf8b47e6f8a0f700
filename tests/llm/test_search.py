"""Ranked search against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from fleetrisk.llm import search
from fleetrisk.llm.tables import reachable
from tests.llm.test_operators import BASE, ROWS, SCHEMA, TEXTS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(rows, items, top=10):
    texts = [(r[0], Counter(terms(r[1]))) for r in rows]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    count, total = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in texts:
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * count // total))) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        for rank, (_, _, i, score) in enumerate(found[:top], 1):
            out[item, rank, i, score] += 1
    return out


ITEMS = [(1, " ".join(BASE.split(" ")[10:40])), (2, "one two"), (2, "one two"), (3, None), (None, "One X a"), (4, TEXTS[5].upper()),
         (5, " ".join(TEXTS[k] for k in range(6))), (6, prose(3000)), (7, "nothing-of-this zzz999"), (8, " .,; ")]


@pytest.fixture(scope="module")
def docs(spark):
    reachable(spark)
    return spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 1, "z") for r in ITEMS], "item_id bigint, text string, item int, rank string").cache()


@pytest.mark.parametrize("block_terms", [search.BLOCK_TERMS, 200])
def test_search_equals_brute_force(docs, items, block_terms):
    got = Counter(map(tuple, search.rank_documents(docs, items, block_terms=block_terms).collect()))
    assert got == expected(ROWS, ITEMS)


def test_search_of_many_copies_and_ties(spark, items):
    """Copies far beyond the wanted number tie, in batches of a few rows."""
    rows = [(k, TEXTS[5] if k % 3 else TEXTS[k % 14], None, None, None) for k in range(400)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
        got = Counter(map(tuple, search.rank_documents(docs, items).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == expected(rows, ITEMS)


def test_search_of_a_very_long_text(spark, items):
    rows = [(1, " ".join([TEXTS[0]] * 16000)), (2, TEXTS[5]), (3, BASE)]
    assert len(rows[0][1]) > 2 << 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, search.rank_documents(docs, items).collect())) == expected(rows, ITEMS)


def test_search_of_empty_tables(docs, items):
    for some in (search.rank_documents(docs.limit(0), items), search.rank_documents(docs, items.limit(0)),
                 search.rank_documents(docs.where("text is null"), items)):
        assert some.columns == ["item_id", "rank", "doc_id", "score"] and some.count() == 0
