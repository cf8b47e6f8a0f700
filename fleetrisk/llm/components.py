"""Connected components of a graph given by its links, as a few joins per round.

Every round each node looks at its smallest neighbour, follows that pointer twice more and
takes the end as its new name; links are renamed and those within one name disappear. Names
only get smaller, a component keeps its smallest node, and the number of links falls fast.
Smallest neighbours are combined before the shuffle, so a hub costs one row per task. Each
round is settled in the shared folder, so lost executors cost no lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle


def _follow(steps: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Renames ``column`` of ``steps`` by the (node, name) pairs; others stay."""
    right = names.select(F.col("node").alias("__node"), F.col("name").alias("__name"))
    return (steps.join(right, steps[column] == F.col("__node"), "left")
            .withColumn(column, F.coalesce("__name", column)).drop("__node", "__name"))


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, comp) after further links (x, y) between ids; the smallest label wins."""
    by_id = labels.select(F.col("id").alias("node"), F.col("comp").alias("name"))
    edges = settle(_apart(_follow(_follow(links.select("x", "y"), by_id, "x"), by_id, "y")), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("name"))
        step = step.select("node", F.least("node", "name").alias("name"))
        step = settle(_follow(step, step, "name"), "step")
        edges = settle(_apart(_follow(_follow(edges, step, "x"), step, "y")), "edges")
        labels = settle(_follow(labels, step, "comp"), "labels")
    return labels


def _apart(edges: DataFrame) -> DataFrame:
    low, high = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    return edges.select(low, high).where("x <> y").distinct()
