"""Distributed running sums and numbering over rows that carry a bucket number.

A bucket is a range of the ordering key, so the buckets of a group follow each other in
order. Only bucket totals (bounded by the number of buckets) are put in sequence; the rows
of a bucket are ordered among themselves in a task of their own. A group that holds a third
of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average.
BUCKET_ROWS = 50_000


def bucket_of(share: Column, rows: Column, bucket_rows: int = BUCKET_ROWS) -> Column:
    """The bucket of a key that is spread evenly over [0, 1), for a group of ``rows`` rows."""
    return F.floor(share * F.ceil(rows / bucket_rows)).cast("bigint")


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: Column, name: str,
                source: DataFrame | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the row's group (0 for the first).

    ``group`` and ``bucket`` hold no NULL. ``source`` is a cheaper frame of the same groups,
    buckets and values to take the bucket totals from.
    """
    totals = (df if source is None else source).groupBy(group, bucket).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Dealt out by both keys, whatever partitioning the frame has: a hot group stays spread.
    rows = df.repartition(group, bucket).withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (rows.join(offsets, [group, bucket])
            .select(*df.columns, (F.col("__before") + F.col("__within")).cast("bigint").alias(name)))
