"""Portfolio cleaning and placeholder plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import bound, has, num, text
from fleetrisk.operators.ranks import dense_numbers

_SUFFIXES = 9000
_LETTERS = 26


def placeholder_plate(index: Column) -> Column:
    """Plate ``A`` + two letters + four digits for a running index.

    When all of these are used up, a round number goes in front of the letters, so no plate repeats.
    """
    used_up = F.floor(index / F.lit(_SUFFIXES * _LETTERS * _LETTERS))
    prefix = F.pmod(F.floor(index / F.lit(_SUFFIXES)), F.lit(_LETTERS * _LETTERS)).cast("int")
    first, second = F.floor(prefix / F.lit(_LETTERS)).cast("int"), F.pmod(prefix, F.lit(_LETTERS))
    letter = lambda i: F.char(F.lit(65) + i)
    suffix = (F.pmod(index, F.lit(_SUFFIXES)) + F.lit(1000)).cast("string")
    rounds = F.when(used_up > 0, used_up.cast("string")).otherwise(F.lit(""))
    return F.concat(F.lit("A"), rounds, letter(first), letter(second), F.lpad(suffix, 4, "0"))


def fill_plates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Give rows without a plate a placeholder, numbered over the missing rows only.

    Rows with a plate are passed through untouched and never shuffled. The missing
    rows are numbered in the order of ``order_by`` (a numeric or time column), or by
    content when the table has no order.
    """
    if not has(df, "Plate"):
        df = df.withColumn("Plate", F.lit(None).cast("string"))
    plate = F.col("Plate").cast("string")
    missing = plate.isNull() | (F.trim(plate) == "")
    named = df.filter(~missing).withColumn("Plate", plate)
    numbered = dense_numbers(df.filter(missing), "__index", order_by)
    numbered = numbered.withColumn("Plate", placeholder_plate(F.col("__index"))).drop("__index")
    return named.unionByName(numbered)


def clean_portfolio(df: DataFrame, order_by: str | None = None, plates_known: bool = False) -> DataFrame:
    """Trimmed names, no unnamed columns, defaults for the keys, floored base price."""
    names = [c.strip() for c in df.schema.names]
    df = df.toDF(*names)
    df = df.select(*[F.col(f"`{c}`") for c in names if not c.startswith("Unnamed:")])
    price = num(df, "Base_Price_USD") if has(df, "Base_Price_USD") else num(df, "Vehicle_Value_USD")
    df = df.withColumns({
        "Type": text(df, "Type", "Sedan"), "Usage": text(df, "Usage", "Private"),
        "Status": text(df, "Status", "Driving"), "City": text(df, "City", K.DEFAULT_CITY),
        "Base_Price_USD": bound(F.coalesce(price, F.lit(6000.0)), low=500.0),
    })
    return df if plates_known else fill_plates(df, order_by)


def select_existing(df: DataFrame, names) -> DataFrame:
    """Projection to the listed columns that the frame has."""
    have = set(df.schema.names)
    return df.select(*[c for c in names if c in have])
