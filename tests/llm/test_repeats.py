"""Long repeats: the run-length index by itself, hot anchors and very long texts."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetrisk.llm import repeats
from fleetrisk.llm.tables import reachable

rng = random.Random(17)


def expected(rows):
    """Covered bytes per (doc_id, text) of rows with different texts, in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(raw[k:k + 100])
        out[doc_id] = (len(raw), sum(gone))
    return out


def test_streamed_matches_are_exact():
    for _ in range(40):
        strings, groups = [], []
        for g in range(rng.randint(1, 6)):
            base = bytes(rng.choice(b"abc") for _ in range(60))
            for _ in range(rng.randint(1, 9)):
                s = bytearray(base[rng.randint(0, 20):rng.randint(35, 60)])
                if rng.random() < 0.4:
                    s[rng.randrange(len(s))] = rng.choice(b"abc")
                strings.append(bytes(s))
                groups.append(g)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        found = repeats.repeated_starts(np.frombuffer(b"".join(strings), np.uint8), starts, np.array(groups), 12)
        for k, s in enumerate(strings):
            for p in range(len(s) - 11):
                assert found[starts[k] + p] == any(s[p:p + 12] in strings[j] for j in range(k) if groups[j] == groups[k])


def test_matching_statistics_are_the_longest_matches():
    """Lengths against plain search, in an index of two parts."""
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 40))) for _ in range(8)]
    parts = np.array([0] * 4 + [1] * 4)
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = repeats.RunIndex(data, starts, parts)
    patterns = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(20)]
    of = np.array([k % 2 for k in range(20)])
    begins = np.concatenate([[0], np.cumsum([len(p) for p in patterns])])
    got = index.matching_statistics(np.frombuffer(b"".join(patterns), np.uint8), begins, of)
    for k, pattern in enumerate(patterns):
        mine = [t for t, part in zip(texts, parts) if part == of[k]]
        for p in range(len(pattern)):
            longest = max(n for n in range(len(pattern) - p + 1) if any(pattern[p:p + n] in t for t in mine))
            assert got[begins[k] + p] == longest
    assert len(index.run_start) <= len(data) + len(texts)


@pytest.mark.parametrize("crowded", [2_000, 8])
def test_a_hot_anchor_with_many_surroundings(spark, monkeypatch, crowded):
    """One line in every text, between changing neighbours; contexts cut by place, and not."""
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    line = "a very common line of the corpus that stands in every single one of all the documents"
    words = ["".join(rng.choice("bcdfg") for _ in range(3)) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(6)]
        rows.append((k, f" {line} ".join(parts)))
    rows += [(200 + k, rows[k][1][3:]) for k in range(10)]
    docs = reachable(spark).createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert got == expected(rows) and sum(n for _, n in got.values()) > 10_000


def test_a_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(240_000))
    rows = [(1, long), (2, "x" * 50 + long[5_000:5_400] + "y" * 60), (3, long), (4, None), (5, "z" * 500)]
    assert len(long) > 2 << 20
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id bigint, text string, id int, f1 int, marks string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (len(long), 0, 0), 2: (510, 400, 1), 3: (len(long), len(long), 1), 4: (0, 0, 0), 5: (500, 499, 1)}


def test_a_block_without_any_repeat(spark):
    """Texts that share an anchor but no string of 100 bytes lose nothing; a block of such contexts has no marks."""
    def words(n):
        return "".join(rng.choice("bcdfghjklm") for _ in range(n))
    shared = words(90)
    rows = [(k, words(70) + shared + words(70)) for k in range(6)] + [(9, words(200))]
    texts = "".join(x for _, x in rows).encode()
    starts = np.cumsum([0] + [len(x) for _, x in rows])
    numbers = np.arange(len(rows))
    block = repeats._block(numbers * 0, numbers, numbers, numbers << 23, np.frombuffer(texts, np.uint8), starts)
    assert block.num_rows == 0 and block.schema.names == ["id", "f1", "tag", "begin", "end"]
    got = repeats.remove_repeats(reachable(spark).createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got} == expected(rows) and not any(r.n_removed for r in got)


def test_repeated_rows_are_judged_alike(spark):
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(7, text), (7, text), (9, text), (None, text), (None, text), (9, "short")]
    got = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    n = len(text)
    assert got == Counter([(7, 0), (7, 0), (9, n), (None, n), (None, n), (9, 0)])


def test_shared_bytes_of_suffixes_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(0, 2, size).astype(np.uint8)) * 3 for size in (1, 7, 8, 9, 30, 30, 55)] + [b"", b"ab" * 40, b"ab" * 33]
    starts = np.cumsum([0] + [len(x) for x in strings])
    parts = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 2])
    index = repeats.RunIndex(np.frombuffer(b"".join(strings), np.uint8), starts, parts)
    suffixes = [(part, x[k:]) for part, x in zip(parts, strings) for k in range(len(x) + 1)]
    a, b = rng.integers(0, len(suffixes), (2, 4_000))
    most = rng.integers(0, 70, 4_000)
    wanted = []
    for x, y, limit in zip(a, b, most):
        (p, s), (q, t) = suffixes[x], suffixes[y]
        same = next((k for k, (c, d) in enumerate(zip(s, t)) if c != d), min(len(s), len(t))) if p == q else 0
        wanted.append(min(same, limit))
    assert index._common(a, b, most).tolist() == wanted


def test_the_digest_takes_no_arrays_of_the_size_of_a_text():
    text = "".join(map(str, range(600_000)))
    marks = [{"begin": 10, "end": 300}, {"begin": 200, "end": 400}, {"begin": 400, "end": 450}, {"begin": 900, "end": 1_000_000}]
    rows = [(1, text, marks), (2, text[:200], [{"begin": -1, "end": -1}, {"begin": 3, "end": 103}]), (3, "", None), (4, text[:300], [])]
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind)],
                                       names=["doc_id", "text", "marks"])
    tracemalloc.start()
    out = [x for b in repeats._cut(iter([batch])) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"]) for x in out] == [
        (len(text), 440 + 999_100, 2), (200, 200, 1), (0, 0, 0), (300, 0, 0)]
    kept = [text[:10] + text[450:900] + text[1_000_000:], "", "", text[:300]]
    assert [x["kept_sha256"] for x in out] == [hashlib.sha256(k.encode()).hexdigest() for k in kept]
    assert peak < 10e6  # with a counter for every byte it was over 50 MB
