"""The training-data operators on small awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetrisk.llm import (decontaminate, factorisation, jaccard, langid, licences, lines, mixing, quality, repeats,
                           sharding)
from fleetrisk.llm.tables import reachable
from fleetrisk.llm.textbatch import mix, pieces

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, id string, group string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "q" + rng.choice(VOCABULARY)
    return " ".join(words)


BASE = prose(150)
TEXTS = [prose(rng.randint(12, 90)) for _ in range(14)]
TEXTS += [edited(BASE, k % 4) for k in range(8)] + [BASE, BASE, TEXTS[0]]
TEXTS += [TEXTS[1] + "\n" + BASE[:400], "one two", "one two", "", None, " \n\t", "x", prose(6000), "a" * 300,
          "Licensed under the Apache License, Version 2.0.\n" + prose(20), "said twice\nsaid twice\n" + prose(15)]
ROWS = [(k, t, None if k % 9 == 4 else "ab"[k % 2], None if k % 7 == 3 else f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[2], ROWS[15], (None, TEXTS[3], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    reachable(spark)
    return spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, " ".join(BASE.split(" ")[10:40])), (2, "one two"), (2, "one two"), (3, None), (None, ""), (4, TEXTS[5].upper())]
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_contamination_equals_brute_force(docs, benchmark, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for item in benchmark.collect():
        w = word.findall((item.text or "").translate(lower))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(str(item.item_id))
    expected = Counter()
    for row in ROWS:
        w = word.findall((row[1] or "").translate(lower))
        hit, items = set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    items |= owners
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        expected[row[0], len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter(map(tuple, decontaminate.contamination(docs, benchmark).collect())) == expected
    assert Counter(map(tuple, decontaminate.contamination(docs, benchmark, 300).collect())) == expected  # several blocks
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.schema == docs.schema and clean.count() == sum(n for k, n in expected.items() if not k[-1])


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * sharding.FACTOR + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark, docs, empty):
    keys = spark.range(-50, 200).union(spark.range(2**63 - 20, 2**63 - 1))
    for shards in (1, 24, 25, 200):
        got = keys.select("id", sharding.jump_shard(F.col("id"), shards).alias("s")).collect()
        assert all(r.s == jump(r.id, shards) for r in got)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS) and all(r.grown_shard in (r.shard, 24) for r in rows)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == len(ROWS) and rows and all(r.taken <= 3 * r["size"] for r in rows)
    per = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in per) - sum(s for s, _ in per)) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in per)
    taken, largest = Counter(), Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r["size"])
    assert all(abs(taken[k] - k[1]) <= largest[k] / 2 + 1 for k in per)
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(empty).count() == 0


def test_mixed_rows_are_the_taken_copies(spark):
    # Many repeats of one row straddle the cut; extra columns come along.
    rows = [(k, f"w {'x ' * (k % 7)}", s) for s in ("a", "b", "c", None) for k in range(20)] + [(5, "one two three", "a")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    wanted = Counter()
    for r in mixing.mix_documents(docs).collect():
        wanted[r.doc_id, r["size"], r.source_size] += r.copies
    size = F.size(F.split(F.trim("text"), " ")).cast("bigint")
    totals = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    got = (mixing.mixed(docs).withColumn("size", size).alias("m").join(totals.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
           .groupBy("doc_id", "size", "source_size").count().collect())
    assert Counter({(r.doc_id, r["size"], r.source_size): r["count"] for r in got}) == +wanted


def test_wide_bitmaps_bound_the_difference():
    for n, own in ((300, 40), (5000, 200), (5000, 3000)):
        base = [rng.getrandbits(64) for _ in range(n)]
        x = np.unique(np.array(base, np.uint64))
        y = np.unique(np.array(base[own:] + [rng.getrandbits(64) for _ in range(own // 2)], np.uint64))
        common, words = len(np.intersect1d(x, y)), min(len(jaccard.parity(x)), len(jaccard.parity(y)))
        apart = np.bitwise_count(jaccard.fold(jaccard.parity(x), words) ^ jaccard.fold(jaccard.parity(y), words)).sum()
        assert apart <= len(x) + len(y) - 2 * common
        assert jaccard._may(jaccard.parity(x), jaccard.parity(y), len(x), len(y), 80) >= jaccard.linked(common, len(x), len(y), 80)
    assert not jaccard._may(jaccard.parity(x), jaccard.parity(y), len(x), len(y), 80)


@pytest.mark.parametrize("percent, size, list_rows", [(90, 3, None), (80, 5, None), (80, 3, 4)])
def test_near_copies_equal_brute_force(docs, empty, monkeypatch, percent, size, list_rows):
    monkeypatch.setattr(jaccard, "WIDE_FROM", 5)
    if list_rows:  # every index list of more entries is cut into lists of two parts each
        monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)

    def shingled(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    sets = [shingled(r[1]) for r in ROWS]
    comp = list(range(len(ROWS)))
    for x in range(len(ROWS)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= percent * len(sets[x] | sets[y]) or (ROWS[x][0] is not None and ROWS[x][0] == ROWS[y][0]):
                old, new = comp[x], comp[y]
                comp = [new if c == old else c for c in comp]
    smallest = {c: min((ROWS[k][0] for k in range(len(ROWS)) if comp[k] == c and ROWS[k][0] is not None), default=None) for c in comp}
    expected = Counter((r[0], len(s), smallest[c]) for r, s, c in zip(ROWS, sets, comp))
    assert Counter(map(tuple, jaccard.near_copies(docs, percent, size).collect())) == expected
    kept = jaccard.keep_one(docs, percent, size)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for s, c in zip(sets, comp) if s}) + sum(not s for s in sets)
    assert jaccard.near_copies(empty).count() == 0


def test_families_find_every_link():
    base = np.unique(np.array([rng.getrandbits(60) for _ in range(200)], np.uint64))
    def variant(k):
        return np.unique(np.concatenate([base[k:], np.array([rng.getrandbits(60) for _ in range(k)], np.uint64)]))
    family, members = jaccard.Family(base), [variant(k) for k in (0, 4, 9, 15)]
    for k, m in enumerate(members):
        family.add(k, m)
    family.close()
    for k in range(30):
        s = variant(k)
        some = any(jaccard.linked(len(np.intersect1d(s, m)), len(s), len(m)) for m in members)
        assert (family.visit(s, 90) is not None) == some


def test_repeats_equal_brute_force(docs, empty):
    seen, results = set(), {}
    for doc_id, text in sorted({(r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()) for r in ROWS}):
        gone, new = bytearray(len(text)), set()
        for k in range(len(text) - 99):
            if text[k:k + 100] in seen or text[k:k + 100] in new:
                gone[k:k + 100] = b"\1" * 100
            new.add(text[k:k + 100])
        seen |= new
        left = bytes(b for b, g in zip(text, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        results[doc_id, text] = (len(text), sum(gone), spans, hashlib.sha256(left).hexdigest())
    expected = Counter((r[0], *results[r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()]) for r in ROWS)
    assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == expected
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_many_texts_without_an_id(spark):
    reachable(spark)
    shared = prose(40)
    own = [shared + " " + prose(10) for _ in range(12)] + [prose(5) + " " + shared for _ in range(12)] + [prose(40) for _ in range(600)]
    rows = [(None, t) for t in own + own[:3]] + [(7, own[20]), (7, prose(30) + shared), (7, shared + prose(30))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    seen, results = set(), {}
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("f1")).distinct().collect()
    for r in sorted(hashed, key=lambda r: (1 << 63 if r.doc_id is None else r.doc_id, r.f1)):
        text = r.text.encode()
        gone, new = bytearray(len(text)), set()
        for k in range(len(text) - 99):
            if text[k:k + 100] in seen or text[k:k + 100] in new:
                gone[k:k + 100] = b"\1" * 100
            new.add(text[k:k + 100])
        seen |= new
        left = bytes(b for b, g in zip(text, gone) if not g)
        results[r.doc_id, r.text] = (len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    expected = Counter((d, *results[d, t]) for d, t in rows)
    assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == expected


def test_quality_counts_equal_brute_force(docs, empty):
    expected = Counter()
    for row in ROWS:
        text = row[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, copies = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                copies += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for d in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        expected[row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), failed] += 1
    rows = quality.measure(docs).collect()
    assert Counter(tuple(r[:7]) for r in rows) == expected
    assert all(not (r.kept and r.base_failed) for r in rows)
    assert quality.measure(empty).count() == 0 and quality.keep_good(docs).schema == docs.schema


def test_a_rare_language_is_not_held_against_others(spark):
    draw = random.Random(8)
    latin = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    greek = ["".join(draw.choice("αβγδεζηθικ") for _ in range(draw.randint(2, 7))) for _ in range(20)]
    text = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(k, text(latin, 800), "la") for k in range(100)] + [(100, text(greek, 70), "el"), (101, text(greek, 70), "la"), (102, text(greek, 70), None)]
    rows += [(103, text(greek, 5), "el")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    kept = lambda frame: {r.doc_id for r in quality.measure(frame).where("kept and doc_id >= 100").collect()}
    assert kept(docs) == {100} and {r.doc_id for r in quality.keep_good(docs).where("doc_id >= 100").collect()} == {100}
    more = docs.union(spark.createDataFrame([(200, text(greek, 600), "el"), (201, text(greek, 600), "el")], docs.schema))
    assert kept(more.where("doc_id < 10 or doc_id >= 100")) == kept(more) == {100, 101, 102, 200, 201}


def test_reference_counts_are_exact(spark, docs, monkeypatch):
    def count(batches):  # tasks hand their counts on after every piece
        quality.HELD_WORDS = 1
        yield from exact(batches)
    exact = quality._count
    monkeypatch.setattr(quality, "_count", count)
    failed = {(r.doc_id, r.n_words): r.base_failed for r in quality.measure(docs).collect()}
    words = defaultdict(Counter)
    for doc_id, text, lang, *_ in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if lang is not None and not failed[doc_id, len(w)]:
            words[lang].update(w)
    got = defaultdict(list)
    for r in quality.references(docs).collect():
        got[r.lang, r.kind].append(r.n)
    for lang, counts in words.items():
        assert got[lang, "all"] == [sum(counts.values())] and len(got[lang, "class"]) == len(quality.CLASSES)
        assert sorted(got[lang, "word"], reverse=True) == [n for _, n in counts.most_common(quality.COMMON_WORDS)]


def test_divergence_bounds():
    same = np.array([0.5, 0.25, 0.25])
    assert quality.distance(np.array([[2, 1, 1]]), same)[0] < 1e-9
    assert abs(quality.distance(np.array([[0, 0, 0, 3]]), np.array([1.0, 0, 0, 0]))[0] - 1) < 1e-9


def test_licences(docs, empty):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.")
    ids, unknown = licences.sentence_ids(mit + " A licence nobody knows. Released under the MIT License.")
    assert ids == ["mit-grant", "mit-notice", "mit-released"] and unknown == 1 and licences.match_rules(ids) == ["MIT", "MIT"]
    assert all(re.search(licences.TRIGGER, s) or "gpl-no-warranty" == n or n.startswith(("apache-2-c", "cc-", "agpl", "bsd"))
               for n, many in licences.SENTENCES.items() for s in many)
    rows = licences.scan_licences(docs).collect()
    assert len(rows) == len(ROWS) and [r.licences for r in rows if r.licences] == [["Apache-2.0"]]
    assert licences.scan_licences(empty).count() == 0


def test_wrapped_licences_are_found(spark):
    cut = lambda text, width, mark: "\n".join(mark + line for line in textwrap.wrap(text, width))
    for width, mark in ((72, ""), (78, " * "), (40, "# "), (25, "// "), (60, "dnl ")):
        for licence, ids in licences.RULES:  # the first wording of each sentence, wrapped, as paragraphs
            text = f"{mark}\n".join(cut(licences.SENTENCES[k][0].capitalize() + ".", width, mark) + "\n" for k in ids)
            assert licences.sentence_ids(text) == (list(ids), 0), (licence, width, mark)
            assert licences.match_rules(list(ids)) == [licence]
    gpl = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License "
           "as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\n"
           "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
    mpl = ("/* This Source Code Form is subject to the terms of the Mozilla Public License,\n * v. 2.0. If a copy of the MPL was not "
           "distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n")
    bsd = ("Copyright (c) 2020, X Inc. and\nothers. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the "
           "above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2) Redistributions in binary form must reproduce "
           "the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials "
           "provided with the distribution.\n")
    apache = ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the "
              "License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by "
              "applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT "
              "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language.\n")
    unlicense = "This is free and unencumbered software released into the public\ndomain."
    texts = {"GPL-2.0-or-later": gpl, "MPL-2.0": mpl, "BSD-2-Clause": bsd, "Apache-2.0": apache, "Unlicense": unlicense,
             "LicenseRef-Proprietary": "Copyright (c) 2020 X. All rights reserved.", "MIT": "some title\nReleased under the MIT License\nmore prose"}
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    assert [r.licences for r in sorted(licences.scan_licences(frame).collect())] == [[x] for x in texts]
    assert licences.sentence_ids(gpl)[0] == ["gpl-2-redistribute", "gpl-no-warranty"]
    assert licences.sentence_ids(apache) == (["apache-2-licensed", "apache-2-comply", "apache-2-copy", "apache-2-basis"], 1)
    assert licences.sentence_ids("A licence that is\nwrapped; one licence.\n\nCopyright law is not all rights reserved.") == ([], 2)


def test_lines(spark, docs, empty):
    rows = {r.doc_id: r for r in lines.dedup_lines(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert rows[len(TEXTS) - 1].n_lines == 3 and rows[len(TEXTS) - 1].n_exact == 1
    first = "the quick brown fox jumps over it"
    near = spark.createDataFrame([(1, first), (2, first.replace("quick", "quack")), (3, first + "!!"), (4, first[3:] + "??")],
                                 "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_near) for r in lines.dedup_lines(near).collect()) == [(1, 0), (2, 1), (3, 1), (4, 0)]
    assert lines.dedup_lines(empty).count() == 0


def test_lines_and_their_gram_bits():
    """Places, code points and 3-gram parities of lines of one to four bytes a character, against plain Python."""
    texts = ["plain line\n\n \t\nx", None, "", "caf\u00e9 \u65e5\u672c\u8a9e\n\U0001f600\U0001f601 wide \U0001f600\uffff", "ab", "\n\u00e9", "end \n"]
    for rows in (texts, ["only ascii\nab\nabc"], [None, ""], []):
        for piece in pieces(pa.array(rows, pa.string())):
            found = lines.Lines(piece)
            low, high = (x.view("uint64").tolist() for x in lines.gram_bits(found))
            own = [(r, k, line) for r, t in enumerate(rows) for k, line in enumerate((t or "").split("\n")) if line.strip(" \t")]
            assert list(zip(found.row.tolist(), found.number.tolist())) == [(r, k) for r, k, _ in own]
            for (_, _, line), begin, end, *words in zip(own, found.begin, found.end, low, high):
                points = [mix(np.array([ord(c) + 1], np.uint64))[0] for c in line]
                assert found.values[begin:end].tolist() == points
                bits = 0
                for a, b, c in zip(points, points[1:], points[2:]):
                    bits ^= 1 << ((3 * (int(a) >> 32) + 5 * (int(b) >> 32) + 7 * (int(c) >> 32)) % (1 << 32) >> 25)
                assert words == [bits % (1 << 64), bits >> 64]


def test_lines_of_documents_without_an_id(spark):
    reachable(spark)
    head = "a header line that all of them share"
    texts = [f"{head}\n{'the quick brown fox jumps over it' + '!' * (k % 3)}\nown line number {k} {prose(6)}" for k in range(9)]
    rows = [(None, t) for t in texts + texts[:2]] + [(None, ""), (None, None), (3, head), (3, texts[4]), (3, texts[4] + "\n" + head), (2, prose(9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]
    named = {tuple(r) for r in docs.select("doc_id", F.xxhash64("text").alias("name"), "text").collect()}
    order = sorted(named, key=lambda r: (1 << 63 if r[0] is None else r[0], r[1]))
    found = [(d, t, k, line) for d, _, t in order for k, line in enumerate((t or "").split("\n")) if line.strip()]
    first = {}
    for place, (*_, line) in enumerate(found):
        first.setdefault(line, place)
    near = {x for x in first for y in first if len(x) >= 24 and len(y) >= 24 and first[y] < first[x] and distance(x, y) <= 2}
    counts = defaultdict(lambda: [0, 0, 0])
    for place, (d, t, _, line) in enumerate(found):
        exact = first[line] != place
        for k, one in enumerate((1, exact, line in near and not exact)):
            counts[d, t][k] += one
    assert Counter(map(tuple, lines.dedup_lines(docs).collect())) == Counter((d, *counts[d, t]) for d, t in rows)


def test_classifiers_survive_awkward_tables(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    rows = factorisation.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in factorisation.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    found = langid.identify(docs).collect()
    assert len(found) == len(ROWS) and all(r.lang_pred in ("a", "b", "und") and 0 <= r.score <= 1 for r in found)
    assert langid.identify(empty).count() == 0


def test_sum_of_squares_identity():
    machine = factorisation.Machine.fresh()
    index, value = np.array([3, 9, 4]), np.array([0.5, -1.0, 2.0])
    pairs = sum(machine.factor[index[i]] @ machine.factor[index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert abs(machine.margin(np.array([0, 3]), index, value)[0] - pairs) < 1e-9
