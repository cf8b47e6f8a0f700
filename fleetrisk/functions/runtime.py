"""Settling intermediate tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of its own is made only where none is named and Spark runs on one machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Name a shared folder in {CHECKPOINT_CONF} before settling tables.")
    made = tempfile.mkdtemp(prefix="settled-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def settle(df: DataFrame, name: str = "settled", file_rows: int = 0) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and go on from there.

    Unlike a checkpoint the table is columnar, so later passes read only the columns they
    need. It survives the loss of executors; the caller's cluster clears the folder.
    With ``file_rows`` no file holds more rows, so that later passes have tasks for all cores
    even where one task wrote the table; the order of a task's rows stays. Spark joins small
    files when it reads them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
