"""Readers and writers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetrisk.functions.runtime import settle

UNSUPPORTED = "Unsupported upload format. Use CSV or Parquet."


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files; without one the types are inferred."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The typed rows of a CSV file, and the lines that do not fit the schema (column ``line``).

    A line with too few, too many or mistyped cells is rejected as it stands; every line is in
    exactly one of the two tables. The file is read once; both tables read the settled result.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    mark = "_rejected"
    while mark in fields.names:
        mark = f"_{mark}"
    whole = StructType([*fields.fields, StructField(mark, StringType())])
    rows = settle(spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark)
                  .schema(whole).csv(path), "csv")
    return rows.where(F.col(mark).isNull()).drop(mark), rows.where(F.col(mark).isNotNull()).select(F.col(mark).alias("line"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table scan."""
    return spark.read.parquet(path)


def load_portfolio(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Reader by suffix; an unknown suffix is tried as CSV."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return read_parquet(spark, path)
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    if suffix in (".xls", ".xlsx"):
        raise ValueError(UNSUPPORTED)
    try:
        frame = read_csv(spark, path, schema)
    except Exception as error:
        raise ValueError(UNSUPPORTED) from error
    if not frame.columns:
        raise ValueError(UNSUPPORTED)
    return frame


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Vehicle records as JSON lines, the batch form of scoring single records."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, written by all tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """One-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _only_missing(error: AnalysisException) -> None:
    """Lets a missing path pass; any other failure is an error."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def read_json_row(spark: SparkSession, path: str) -> Mapping | None:
    """The summary row, or None where there is none."""
    try:
        row = spark.read.json(path).limit(1).collect()
    except AnalysisException as error:
        _only_missing(error)
        return None
    return row[0].asDict(recursive=True) if row else None


class StateConflict(RuntimeError):
    """Another writer has committed the state that this one was about to replace."""


class StateTable:
    """I8: a keyed state table with atomic replacement, safe against several writers.

    Each version is written to a folder of its own. It becomes current by a commit file with the
    next number as its name, which is created only where no such file exists: of two writers that
    start from one version, the first one commits and the second gets ``StateConflict``. Readers
    see the old or the new state and never a mixture. Versions are numbered; the highest number
    is current, whatever the clocks say.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._seen: int | None = None

    def _files(self, name: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()), path

    def _commits(self) -> dict[int, str | None]:
        """Version folders by number; None where a writer ended before it had named its folder."""
        files, path = self._files("current")
        if not files.exists(path):
            return {}
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return {int(name): self._folder(name) for name in names if not name.startswith((".", "_"))}

    def _folder(self, name: str) -> str | None:
        files, path = self._files(f"current/{name}")
        if files.getFileStatus(path).getLen() == 0:
            return None
        stream = files.open(path)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The current state; a later ``replace`` of this table object takes its place."""
        commits = self._commits()
        self._seen = max(commits, default=0)
        whole = [number for number, folder in commits.items() if folder]
        return self._spark.read.parquet(f"{self._path}/{commits[max(whole)]}") if whole else None

    def replace(self, df: DataFrame, keep: int = 2) -> int:
        """Commits ``df`` in place of the state that was read last, and returns its number.

        Without an earlier ``read`` it takes the place of the state that is current at the start.
        The ``keep`` latest versions stay readable; older ones are removed.
        """
        base = self._seen if self._seen is not None else max(self._commits(), default=0)
        version = f"version={uuid.uuid4().hex}"
        df.write.parquet(f"{self._path}/{version}")
        files, path = self._files(f"current/{base + 1:012d}")
        files.mkdirs(path.getParent())
        try:
            stream = files.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            files.delete(self._files(version)[1], True)
            raise StateConflict(f"Version {base + 1} of {self._path} was committed by another writer.") from error
        stream.writeUTF(version)
        stream.close()
        self._seen = base + 1
        for number, folder in self._commits().items():
            if number <= self._seen - max(1, keep):
                for name in filter(None, (folder, f"current/{number:012d}")):
                    files.delete(self._files(name)[1], True)
        return self._seen
