"""Shared column helpers: open schemas, safe numerics, clipping, bins, rounding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRACTIONAL = (T.DoubleType, T.FloatType)


def has(df: DataFrame, name: str) -> bool:
    return name in df.schema.names


def _numeric(df: DataFrame, name: str) -> Column:
    """Column as double: unreadable text and NaN become NULL."""
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.DoubleType):
        value = col
    elif isinstance(dtype, T.StringType):
        value = F.trim(col).try_cast("double")
    else:
        value = col.cast("double")
    if isinstance(dtype, _FRACTIONAL) or isinstance(dtype, T.StringType):
        value = F.nullif(value, F.lit(float("nan")))
    return value


def num(df: DataFrame, name: str, default: float | Column | None = None) -> Column:
    """Safe numeric read of a possibly absent column, with an optional default."""
    if default is not None and not isinstance(default, Column):
        default = F.lit(float(default))
    if not has(df, name):
        return default if default is not None else F.lit(None).cast("double")
    value = _numeric(df, name)
    return value if default is None else F.coalesce(value, default)


def first_num(df: DataFrame, names: Sequence[str], default: float | None = None) -> Column:
    """Numeric read of the first of several column names that exists."""
    for name in names:
        if has(df, name):
            return num(df, name, default)
    return num(df, names[0], default)


def text(df: DataFrame, name: str, default: str | None = None) -> Column:
    """Text read of a possibly absent column, with an optional default for NULL."""
    if not has(df, name):
        return F.lit(default).cast("string")
    value = F.col(f"`{name}`").cast("string")
    return value if default is None else F.coalesce(value, F.lit(default))


def stamp(df: DataFrame, name: str) -> Column:
    """Timestamp read: text is parsed with bad values as NULL, other types are kept."""
    if not has(df, name):
        return F.lit(None).cast("timestamp")
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(col)
    if isinstance(dtype, T.DateType):
        return col.cast("timestamp")
    return col


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value that may be NULL; NULL stays NULL (``least``/``greatest`` skip it)."""
    return F.when(value.isNotNull(), bound(value, low, high))


def bound(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value known to be non-NULL."""
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


@lru_cache(maxsize=256)
def _literal_map(pairs: tuple) -> Column:
    return F.create_map(*[F.lit(item) for pair in pairs for item in pair])


def lookup(table: Mapping, key: Column, default=None) -> Column:
    """Dictionary lookup by a literal map, folded into the plan."""
    found = F.try_element_at(_literal_map(tuple(table.items())), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def bin_score(value: Column, bins: Sequence[tuple[float, float]], missing: float = 0.0,
              below: float | None = None) -> Column:
    """Risk of the half-open bin holding ``value``; the last bin is open-ended.

    NULL gives ``missing``; a value under the first edge gives ``below`` (the same
    as ``missing`` when not stated).
    """
    below = missing if below is None else below
    chain = None
    for edge, risk in reversed(bins):
        test = value >= edge
        chain = F.when(test, risk) if chain is None else chain.when(test, risk)
    if missing != below:
        chain = chain.when(value.isNull(), float(missing))
    return chain.otherwise(float(below))


def half_even(value: Column, digits: int) -> Column:
    """Round the scaled double half-to-even, as NumPy does."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({
        name: half_even(F.col(name), n) for name, n in digits.items() if has(df, name)
    })


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that the frame has, in the order asked for."""
    have = set(df.schema.names)
    return [name for name in names if name in have]


class Presence:
    """Answers "does any row of the table hold a value in this column?".

    A fallback that applies only when a *whole* column is empty needs one fact per
    column. Absent columns and columns that the schema rules non-NULL cost nothing; all
    other facts are taken in a single one-row aggregate, read as a scalar subquery. With
    ``known=True`` every present column counts as filled and no pass is made, which is
    the rule for streams, where "the whole column" does not exist.
    """

    COLUMN = "__filled"

    def __init__(self, df: DataFrame, names: Iterable[str], known: bool | Mapping[str, bool] | None = None):
        names = existing(df, names)
        self._row: Column | None = None
        if known is True:
            self._facts = {name: F.lit(True) for name in names}
        elif known is not None:
            self._facts = {name: F.lit(bool(known.get(name, True))) for name in names}
        else:
            asked = [name for name in names if df.schema[name].nullable]
            self._facts = {name: F.lit(True) for name in names}
            if asked:
                facts = [F.coalesce(F.max(_numeric(df, name).isNotNull()), F.lit(False)).alias(name)
                         for name in asked]
                self._row = df.agg(F.struct(*facts).alias("filled")).scalar()
                self._facts.update({name: self._row.getField(name) for name in asked})
                self._asked = asked

    def attach(self, df: DataFrame) -> DataFrame:
        """Carry the facts as one column, so that the subquery appears once in the plan.

        The caller drops ``Presence.COLUMN`` when it is done.
        """
        if self._row is None:
            return df
        df = df.withColumn(self.COLUMN, self._row)
        self._facts.update({name: F.col(self.COLUMN).getField(name) for name in self._asked})
        self._row = None
        return df

    def __call__(self, name: str) -> Column:
        return self._facts.get(name, F.lit(False))

    def asked(self, name: str) -> bool:
        """False when the column is absent, so the fallback can be chosen at plan time."""
        return name in self._facts
