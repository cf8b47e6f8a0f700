"""The corpus pipeline: from raw documents to shards, each stage written and read again.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> mixing -> sharding
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.functions.runtime import shared_folder
from fleetrisk.llm import decontaminate, jaccard, mixing, quality, sharding
from fleetrisk.llm.tables import reachable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language reference."""
    reachable(spark)
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity 0.8 or more."""
    reachable(spark)
    return jaccard.keep_one(docs, percent=80, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, a row for each copy taken."""
    reachable(spark)
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("sharding", sharded),
]

#: The quality stage (divergence from counted references) and link components are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
