"""Key-based joins with overlay semantics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import existing, has, lookup, num, text


def last_rows(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key in the given order.

    The ``= 1`` filter on the row number lets Spark keep one row per key and task before
    the shuffle, so a key that holds most rows is no burden.
    """
    keys = [key] if isinstance(key, str) else list(key)
    latest = Window.partitionBy(*keys).orderBy(*[_desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(latest)).filter("__rn = 1").drop("__rn")


def _desc(order: str | Column) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return col.desc_nulls_last()


def overlay(df: DataFrame, live: DataFrame, columns: Iterable[str], order: Sequence[str | Column] | None = None,
            key: str = "Plate") -> DataFrame:
    """Refresh ``columns`` from the live row of the same key.

    A matched row takes the live value even when it is NULL; an unmatched row keeps its
    own; a column that only the live side has is added. ``order`` picks the last live row
    per key; without it a repeated key takes its greatest row, so rows never multiply.
    """
    columns = [c for c in existing(live, columns) if c != key]
    source = live.select(key, *columns, *[c for c in _names(order) if c not in columns and c != key])
    if order is not None:
        source = last_rows(source, key, order)
    elif columns:
        source = source.groupBy(key).agg(F.max(F.struct(*columns)).alias("__row")).select(key, "__row.*")
    else:
        source = source.distinct()
    source = source.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__live_{c}") for c in columns])
    joined = df.join(source, df[key] == source["__key"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    have = set(df.schema.names)
    out = [F.when(hit, F.col(f"__live_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
           for c in df.schema.names]
    out += [F.col(f"__live_{c}").alias(c) for c in columns if c not in have]
    return joined.select(*out)


def _names(order) -> list[str]:
    return [c for c in (order or []) if isinstance(c, str)]


def refresh_live_columns(df: DataFrame, live: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Overlay of every live-backed snapshot column."""
    return overlay(df, live, K.PREPROCESSED_COLUMNS, order)


def sync_with_raw(risk_table: DataFrame, raw: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Raw values for every column that both tables share."""
    return overlay(risk_table, raw, [c for c in risk_table.schema.names if has(raw, c)], order)


def city_centroids(df: DataFrame) -> DataFrame:
    """Mean position per city, with the fixed centroid where no row has a position."""
    return (df.filter(F.col("City").isNotNull()).groupBy("City")
            .agg(F.avg(F.when(_located(df), num(df, "GPS_Latitude"))).alias("__lat"),
                 F.avg(F.when(_located(df), num(df, "GPS_Longitude"))).alias("__lon"))
            .select("City",
                    F.coalesce("__lat", fixed_centroid(F.col("City"), 0)).alias("lat"),
                    F.coalesce("__lon", fixed_centroid(F.col("City"), 1)).alias("lon")))


def _located(df: DataFrame) -> Column:
    return num(df, "GPS_Latitude").isNotNull() & num(df, "GPS_Longitude").isNotNull()


def fixed_centroid(city: Column, axis: int) -> Column:
    return lookup({name: point[axis] for name, point in K.CITY_CENTROIDS.items()}, city)


def score_lookup(df: DataFrame, scored: DataFrame, column: str = "LightGBM_Risk_Score",
                 order: Sequence[str | Column] | None = None) -> DataFrame:
    """Score by plate; rows without a match get NULL."""
    source = last_rows(scored, "Plate", order) if order else scored
    source = source.select("Plate", F.col(column).cast("double").alias("__score"))
    joined = df.drop(column).join(source, "Plate", "left")
    return joined.withColumnRenamed("__score", column)


def update_while_driving(df: DataFrame, scores: DataFrame, column: str = "Risk_Score",
                         order: Sequence[str | Column] | None = None) -> DataFrame:
    """Take the looked-up value only on driving rows that have a match.

    ``order`` picks the last score per plate; without it a repeated plate takes its greatest.
    """
    source = last_rows(scores, "Plate", order) if order else scores.groupBy("Plate").agg(F.max(column).alias(column))
    source = source.select(F.col("Plate").alias("__key"), F.col(column).alias("__new"))
    joined = df.join(source, df["Plate"] == source["__key"], "left")
    driving = F.lower(text(df, "Status", "")) == "driving" if has(df, "Status") else F.lit(False)
    value = F.when(driving & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("__key", "__new")


def with_prior_state(df: DataFrame, state: DataFrame) -> DataFrame:
    """Previous severity, its time and score per plate (NULL for a new plate)."""
    prior = state.select(F.col("plate").alias("__plate"), F.col("severity").alias("prior_severity"),
                         F.col("last_updated").alias("prior_updated"),
                         F.col("composite_score").alias("prior_composite"))
    return df.join(prior, df["Plate"].cast("string") == prior["__plate"], "left").drop("__plate")


def order_like(df: DataFrame, reference: DataFrame, position: str, key: str = "Plate") -> DataFrame:
    """Sort by the position that the key has in another table; unknown keys go last."""
    first = reference.groupBy(F.col(key).alias("__key")).agg(F.min(position).alias("__order"))
    joined = df.join(first, df[key] == first["__key"], "left").drop("__key")
    return joined.orderBy(F.col("__order").asc_nulls_last(), F.col(key)).drop("__order")


def positional_overlay(df: DataFrame, live: DataFrame, columns: Iterable[str], row_id: str | None = None) -> DataFrame:
    """Overlay without a plate; both tables must carry the same explicit row id."""
    if row_id is None or not (has(df, row_id) and has(live, row_id)):
        raise ValueError("Rows of a table have no position: name a row id column that both tables carry.")
    return overlay(df, live, columns, key=row_id)


def plates_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct plates present in both tables."""
    return (left.select("Plate").filter("Plate IS NOT NULL")
            .join(right.select("Plate"), "Plate", "left_semi").distinct())


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from one frame is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
