"""MinHash near copies against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetrisk.llm import minhash, verify
from fleetrisk.llm.tables import reachable
from tests.llm.test_operators import ROWS, SCHEMA

rng = random.Random(11)


def shingled(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def expected(rows, percent=85, size=5):
    sets = [shingled(r[1], size) for r in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= percent * len(sets[x] | sets[y]) or (rows[x][0] is not None and rows[x][0] == rows[y][0]):
                comp[find(x)] = find(y)
    roots = [find(x) for x in range(len(rows))]
    smallest = {c: min((r[0] for r, d in zip(rows, roots) if d == c and r[0] is not None), default=None) for c in roots}
    return Counter((r[0], len(s), smallest[c] if s else r[0], r[0] == (smallest[c] if s else r[0])) for r, s, c in zip(rows, sets, roots))


def families():
    """Chains and stars of near copies around the bound, of short and of longer texts."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for length in (6, 12, 40, 40, 200, 200, 700):
        base = [word() for _ in range(length)]
        chain = list(base)
        for k in range(14):
            star = list(base)
            for _ in range(rng.randint(0, max(1, length // 45))):
                star[rng.randrange(length)] = word()
            chain[rng.randrange(length)] = word()
            rows += [(len(rows), " ".join(star)), (len(rows) + 1, "\n".join(chain).upper() if k % 2 else " ".join(chain))]
    rng.shuffle(rows)
    return rows + [rows[3], (None, rows[5][1]), (None, "alone without an id " + word()), (None, None), (3, ""), (4, " \t ")]


@pytest.mark.parametrize("limit", [minhash.LIST_ROWS, 5])
def test_near_duplicates_equal_brute_force(spark, limit):
    rows = families()
    docs = reachable(spark).createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id bigint, text string, id int, n int, key string").repartition(3)
    assert Counter(map(tuple, minhash.near_duplicates(docs, limit=limit).collect())) == expected(rows)


def test_awkward_documents(spark):
    docs = reachable(spark).createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA)
    assert Counter(map(tuple, minhash.near_duplicates(docs, 80, 3).collect())) == expected(ROWS, 80, 3)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_very_long_text_and_its_copy(spark):
    words = [f"w{rng.randrange(10**6)}" for _ in range(350_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-20_000])), (3, " ".join(words[100_000:])), (4, "short")]
    assert len(rows[0][1]) > 2 << 20
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}


def test_sub_keys_meet_as_often_as_promised():
    """Share of pairs with a common table, against the tensored bound, at and far below the bound."""
    def share(similarity, n=200, pairs=400):
        both = 2 * n * similarity / (1 + similarity)
        hits = 0
        for _ in range(pairs):
            x = np.array([rng.getrandbits(64) for _ in range(2 * n)], np.uint64)
            keys = minhash.sub_keys([np.unique(x[:n]), np.unique(x[n - int(both):2 * n - int(both)])])
            same = keys[0] == keys[1]
            hits += same[:minhash.KEYS].any() and same[minhash.KEYS:].any()
        return hits / pairs
    assert share(0.86) == 1.0
    low = (1 - (1 - 0.3 ** minhash.ROWS) ** minhash.KEYS) ** 2
    assert abs(share(0.3) - low) < 0.03


def test_partners_of_a_hot_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(verify, "PARTNERS", 4)
    base = [f"v{k}" for k in range(300)]
    rows = []
    for k in range(40):
        text = list(base)
        text[7 * k] = f"own{k}"
        rows.append((k, " ".join(text)))
    got = minhash.near_duplicates(reachable(spark).createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(k, 0) for k in range(40)}


def test_texts_of_one_doc_id_are_judged_apart(spark):
    """Unrelated texts under one doc_id, columns of the names the operators use themselves."""
    from fleetrisk.llm import jaccard
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, one), (1, two), (2, two), (3, three), (3, three), (None, one), (None, "lonely words of no id at all"), (4, None)]
    docs = reachable(spark).createDataFrame([(*r, 7, 8, 9, 10) for r in rows], "doc_id bigint, text string, node int, __id int, id int, twice int")
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    n = len(one.split(" ")) - 4
    assert got == Counter([(1, n, 1, True), (1, n, 1, True), (2, n, 1, False), (3, n, 3, True), (3, n, 3, True), (None, n, 1, False),
                           (None, 3, None, True), (4, 0, 4, True)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, one), (1, two), (3, three), (None, "lonely words of no id at all"), (4, None)])
    assert jaccard.keep_one(docs.limit(0)).count() == 0
