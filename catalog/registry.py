"""Registry of queries: a Spark function and, where SQL can express it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.sqltext import rounded, with_views
from fleetrisk.functions.columns import half_even
from fleetrisk.operators.features import preprocess
from fleetrisk.operators.pricing import apply_policy, profitability
from fleetrisk.operators.scoring import live_risk_outputs
from fleetrisk.sources import testdata

AS_OF = datetime(2024, 2, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """The shared frames, built lazily and only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        build = {
            "history": lambda: testdata.history(self.spark, self.dir),
            "portfolio": lambda: testdata.portfolio(self.spark, self.dir),
            "supply": lambda: testdata.supply_history(self.spark, self.dir),
            "h_prepared": lambda: preprocess(self.history, AS_OF, plates_known=True),
            "h_live": lambda: live_risk_outputs(self.h_prepared),
            "h_priced": lambda: apply_policy(profitability(self.h_live)),
            "prepared": lambda: preprocess(self.portfolio, AS_OF, plates_known=True),
            "live": lambda: live_risk_outputs(self.prepared),
            "priced": lambda: apply_policy(profitability(self.live)),
        }.get(name)
        if build is None:
            return self.table(name)
        frame = build()
        self.__dict__[name] = frame
        return frame

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.dir, name)


def settled(df: DataFrame, digits: int | Mapping[str, int] = 4) -> DataFrame:
    """Round every double column, so that sums taken in another order still agree."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            n = digits if isinstance(digits, int) else digits.get(field.name, 4)
            col = half_even(col, n) + F.lit(0.0)
        out.append(col.alias(field.name))
    return df.select(*out)


def query(key: str, sql: str | None = None, digits: int = 4):
    """Register ``build(views) -> DataFrame``; its double columns are rounded."""
    def keep(build: Callable[[Views], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: settled(build(Views(spark, sf_dir)), digits)
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return build
    return keep


def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    """Rounded SQL column."""
    return f"{rounded(expr, digits)} AS {name or expr}"


def project(key: str, view: str, by: str, plain: Sequence[str] = (), doubles: Sequence[str] = (),
            spark: Callable[[DataFrame], DataFrame] | None = None, names: Mapping[str, str] | None = None,
            digits: int = 6) -> None:
    """A projection of a shared view, the same columns on both sides.

    ``spark`` computes the columns from the view's Spark frame when they are not in it.
    ``names`` maps an output column to the SQL expression behind it.
    """
    names = names or {}
    columns = [by, *plain, *doubles]
    sql = ", ".join([by, *[f"{names.get(c, c)} AS {c}" for c in plain],
                     *[r(names.get(c, c), c, digits) for c in doubles]])

    def build(v: Views) -> DataFrame:
        frame = getattr(v, view)
        frame = spark(frame) if spark else frame
        return frame.select(*columns)

    query(key, f"SELECT {sql} FROM {view}", digits)(build)
