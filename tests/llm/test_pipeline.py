"""The corpus pipeline: each stage's decision takes effect on its own input, empty tables, repeated runs."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetrisk.llm import quality
from fleetrisk.llm.tables import reachable
from tests.llm.test_minhash import shingled

rng = random.Random(23)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = prose(120)
    near = base.split(" ")
    near[60] = "changed"
    item = prose(30)
    rows = [(k, prose(rng.randint(40, 120)), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100, base, "en", "s0"), (101, " ".join(near), "en", "s1"), (102, base, "en", None), (103, prose(20) + " " + item, "en", "s0"),
             (104, "too short", "en", "s0"), (105, None, None, None), (106, "again and again " * 30, "en", "s1"), (None, prose(50), None, None)]
    path = tmp_path_factory.mktemp("corpus")
    docs = reachable(spark).createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(40))], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return path


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination",
                                                            "mixing sources", "sharding"]

    good = stages["quality rules"](spark, docs, str(folder)).cache()
    kept = Counter(r.doc_id for r in quality.measure(docs).where("kept").collect())
    assert Counter(r.doc_id for r in good.collect()) == kept and good.columns == columns
    assert not {104, 105, 106} & set(kept) and {100, 101, 102, 103} <= set(kept)

    one = stages["n-gram Jaccard join"](spark, good, str(folder)).cache()
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in good.collect())
    left = []
    for null, doc_id, text in rows:  # families here are cliques, so the first of each stays
        mine = shingled(text)
        if all(100 * len(mine & other) < 80 * len(mine | other) for _, _, other in left):
            left.append((null, doc_id, mine))
    assert Counter(r.doc_id for r in one.collect()) == Counter(None if null else i for null, i, _ in left) and one.columns == columns
    assert {100, 101, 102} & {r.doc_id for r in one.collect()} == {100}

    clean = stages["benchmark decontamination"](spark, one, str(folder)).cache()
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == {103} and clean.columns == columns

    mixed = stages["mixing sources"](spark, clean, str(folder)).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {r.doc_id for r in clean.collect()} and max(copies.values()) <= 3 and mixed.columns == columns
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    whole, taken = sum(size(r.text) for r in clean.collect()), sum(size(r.text) for r in mixed.collect())
    assert abs(whole - taken) <= 4 * max(size(r.text) for r in clean.collect())

    shards = stages["sharding"](spark, mixed, str(folder)).collect()
    assert len(shards) == mixed.count()
    for shard in {r.shard for r in shards}:
        slots = sorted(r.slot for r in shards if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_whole_runs_agree(spark, folder):
    one, two = (corpus_pipeline.run(spark, str(folder)) for _ in range(2))
    assert one.count() > 30 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_run_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(str(folder / "documents.parquet")).where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(folder / "benchmark.parquet")).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
