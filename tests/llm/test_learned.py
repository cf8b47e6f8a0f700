"""The learned operators: held-out accuracy on the given tables, and samples that keep their bound."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from fleetrisk.llm import factorisation, langid
from fleetrisk.llm.tables import reachable, table

SF = "/root/testdata/sf0.1"


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    good, every = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert good > 0.98 and every > 2000
    assert rows.where("doc_id IS NOT NULL").select("doc_id").first().doc_id >= 0


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = factorisation.score_documents(docs, labels).where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = sum(r.predicted == r.quality for r in rows) / len(rows)
    bad = [r for r in rows if r.quality == 0]
    assert good > 0.98 and sum(r.predicted == 0 for r in bad) / len(bad) > 0.93


def test_the_language_sample_keeps_its_bound(spark):
    """Documents without an id, one id for many, one row many times: all are drawn from, none too often."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(None, " ".join(word("abcd") for _ in range(8)), "x") for _ in range(3000)]
    rows += [(7, " ".join(word("wxyz") for _ in range(8)), "y") for _ in range(2000)] + [(8, "wz wz wz", "y")] * 3000
    rows += [(k, " ".join(word("klmn") for _ in range(8)), "z") for k in range(100, 150)] + [(9, None, "x"), (10, "abc", None)]
    docs = reachable(spark).createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    drawn = {r.lang: (r.n, r.d) for r in langid.drawn_rows(docs, 200).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("d")).collect()}
    assert drawn == {"x": (200, 200), "y": (200, 200), "z": (50, 50)}
    got = {(r.lang_pred, r["count"]) for r in langid.identify(docs.where("doc_id IS NULL")).groupBy("lang_pred").count().collect()}
    assert got == {("x", 3000)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_the_label_sample_keeps_its_bound(spark):
    rows = [(k % 40, f"text {k} of some words " * 4, 9) for k in range(4000)] + [(None, "no id", 1)] * 50
    labels = [(k, k % 2, 0) for k in range(40)] + [(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)]
    docs = reachable(spark).createDataFrame(rows, "doc_id bigint, text string, place int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = factorisation.score_documents(docs, marks, sample=10)
    assert out.count() == len(rows) and out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert factorisation.score_documents(docs, marks.limit(0)).where("score <> 0.5").isEmpty()
