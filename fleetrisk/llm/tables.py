"""The tables of a data folder, and the package within reach of Python workers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

import fleetrisk


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    A cluster that installs the package, or gets it with --py-files, needs nothing of this.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(fleetrisk.__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, a file or a folder of part files."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
