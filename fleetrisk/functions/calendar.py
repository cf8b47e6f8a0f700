"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetrisk.constants import NIGHT_BUCKETS


def hour_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("double") + F.minute(ts).cast("double") / F.lit(60.0)
            + F.second(ts).cast("double") / F.lit(3600.0))


def time_of_day(ts: Column) -> Column:
    """Six day parts; the night hours before 02:00 belong to Late Night."""
    h = F.hour(ts)
    return (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when((h >= 22) | (h < 2), "Late Night")
        .when(h < 5, "Dawn")
        .when(h < 10, "Morning Rush")
        .when(h < 17, "Mid-Day")
        .when(h < 20, "Evening Rush")
        .otherwise("Night")
    )


def day_name(ts: Column) -> Column:
    """Full English day name."""
    return F.date_format(ts, "EEEE")


def night_flag(bucket: Column) -> Column:
    """1 in a night bucket, else 0 (also for an unknown bucket)."""
    return F.coalesce(bucket.isin(*NIGHT_BUCKETS), F.lit(False)).cast("int")


def stamp_parts(ts: Column) -> dict[str, Column]:
    """Calendar parts of the update time."""
    return {
        "Update_Year": F.year(ts), "Update_Month": F.month(ts), "Update_Day": F.dayofmonth(ts),
        "Update_Hour": F.hour(ts), "Update_Minute": F.minute(ts),
    }
