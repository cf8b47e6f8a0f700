"""Driver statistics and ordered per-vehicle operators.

Ordered work on one vehicle is split into time blocks: each block is finished on its
own, and only one summary row per block is put in sequence to hand the state over.
A block of too many rows is cut into ever smaller spans of time, so a vehicle that holds
most rows of an hour is spread, too. Rows of one vehicle and one instant stay together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.calendar import night_flag
from fleetrisk.functions.columns import half_even, has, num, stamp, text
from fleetrisk.functions.runtime import settle

HOUR = 3600
DAY = 24 * HOUR
#: Rows of one block; a block of more is cut into spans of time.
BLOCK_ROWS = 100_000
#: Spans that a crowded span is cut into.
_FANOUT = 64


def _epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _with_parts(df: DataFrame, key: str, block: str, pos: str, width: int, block_rows: int) -> DataFrame:
    """Add ``__part``, which numbers spans of ``pos`` (0 .. width - 1) within a block in order.

    A block of at most ``block_rows`` rows is one part. A span of more is cut into equal spans
    until each has few enough rows or is a single instant. Only counts are settled.
    """
    counts = df.groupBy(key, block).agg(F.count(F.lit(1)).alias("__rows"))
    crowded = settle(counts.where(F.col("__rows") > block_rows).select(key, block, F.lit(0).cast("bigint").alias("__from")), "crowded")
    if crowded.isEmpty():
        return df.withColumn("__part", F.lit(0))
    rows, starts = df.select(key, block, pos).withColumn("__from", F.lit(0).cast("bigint")), None
    while width > 1 and not crowded.isEmpty():
        width = -(-width // _FANOUT)
        rows = rows.join(crowded, [key, block, "__from"])
        rows = rows.withColumn("__from", F.col("__from") + F.floor((F.col(pos) - F.col("__from")) / F.lit(width)) * F.lit(width))
        spans = settle(rows.groupBy(key, block, "__from").agg(F.count(F.lit(1)).alias("__rows")), "spans")
        crowded = spans.where(F.col("__rows") > block_rows).drop("__rows")
        starts = spans.drop("__rows") if starts is None else starts.union(spans.drop("__rows"))
    cuts = starts.groupBy(key, block).agg(F.collect_set("__from").alias("__cuts"))
    before = F.size(F.filter(F.coalesce("__cuts", F.array()), lambda cut: cut <= F.col(pos)))
    return df.join(cuts, [key, block], "left").withColumn("__part", before).drop("__cuts")


def _blocked(df: DataFrame, key: str, ts: str, block_seconds: int, block_rows: int) -> DataFrame:
    """Add ``__block``, a struct that numbers bounded blocks of a key in time order."""
    width = block_seconds * 1_000_000
    at = _epoch_micros(F.col(ts))
    df = df.withColumn("__day", F.floor(at / F.lit(width)))
    df = df.withColumn("__pos", at - F.col("__day") * F.lit(width))
    df = _with_parts(df, key, "__day", "__pos", width, block_rows)
    return df.withColumn("__block", F.struct("__day", "__part")).drop("__day", "__pos", "__part")


def with_previous(df: DataFrame, key: str, ts: str, columns: Sequence[str], tiebreak: Sequence[str] = (),
                  block_seconds: int = DAY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``prev_<column>``: the value on the key's row before this one in time order.

    Also leaves the block number in ``__block``.
    """
    order = [ts, *tiebreak]
    blocked = _blocked(df, key, ts, block_seconds, block_rows)
    last = blocked.groupBy(key, "__block").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    sequence = Window.partitionBy(key).orderBy("__block")
    carried = last.withColumn("__carry", F.lag("__last").over(sequence)).drop("__last")
    joined = blocked.join(carried, [key, "__block"])
    inside = Window.partitionBy(key, "__block").orderBy(*order)
    first = F.row_number().over(inside) == 1
    return joined.withColumns({
        f"prev_{c}": F.when(first, F.col("__carry").getField(c)).otherwise(F.lag(c).over(inside))
        for c in columns
    }).drop("__carry")


def last_n_rows(history: DataFrame, n: int, key: str = "Plate", ts: str = "Last_Update",
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows per key, limited per task before the shuffle."""
    latest = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in tiebreak])
    return history.withColumn("__rn", F.row_number().over(latest)).filter(F.col("__rn") <= n)


def _counters(df: DataFrame) -> dict[str, Column]:
    harsh = (num(df, "Harsh_Brake_Count", 0.0) + num(df, "Harsh_Accel_Count", 0.0)
             + num(df, "Harsh_Corner_Count", 0.0))
    if has(df, "Recent_Harsh_Events"):
        harsh = F.greatest(harsh, num(df, "Recent_Harsh_Events", 0.0))
    night = (num(df, "Night_Driving_Flag", 0.0).cast("int") if has(df, "Night_Driving_Flag")
             else night_flag(text(df, "Time_of_Day")))
    return {
        "_harsh": harsh, "_km": num(df, "Trip_Distance_km", 0.0), "_night": night.cast("double"),
        "_speeding": num(df, "Speeding_Flag", 0.0).cast("int"), "_speed": num(df, "Speed_kmh", 0.0),
        "_accel": num(df, "Acceleration_mps2", 0.0), "_load": num(df, "Engine_Load_pct", 0.0),
        "_coolant": num(df, "Coolant_Temp_C", 0.0),
    }


def _increment(value: str, previous: Column) -> Column:
    """Growth of a cumulative counter; a reset counts as zero, a first row in full."""
    step = F.col(value) - previous
    return F.when(step.isNull(), F.col(value)).otherwise(F.greatest(step, F.lit(0.0)))


def driver_increments(history: DataFrame, key: str = "Plate", ts: str = "Last_Update",
                      tiebreak: Sequence[str] = (), lookback: int | None = 120) -> DataFrame:
    """W3 then W1: per-row harsh, distance and night-distance increments.

    With a look-back the rows kept per driver are few, so one window does it: the same
    sort serves the row limit and the step to the earlier row (``lead`` in descending
    order). Without one, the time-block form is used.
    """
    df = history.withColumn(key, text(history, key, "None")).withColumn(ts, stamp(history, ts))
    df = df.filter(F.col(ts).isNotNull())
    carried = ["City", "Status"]
    df = df.select(key, ts, *[c for c in tiebreak if c not in (key, ts)],
                   *[text(df, c).alias(c) for c in carried],
                   *[c.alias(n) for n, c in _counters(df).items()])
    if lookback is None:
        df = with_previous(df, key, ts, ["_harsh", "_km"], tiebreak).drop("__block")
        before_harsh, before_km = F.col("prev__harsh"), F.col("prev__km")
    else:
        df = last_n_rows(df, int(lookback), key, ts, tiebreak)
        latest = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in tiebreak])
        df = df.withColumns({"prev__harsh": F.lead("_harsh").over(latest), "prev__km": F.lead("_km").over(latest)})
        before_harsh, before_km = F.col("prev__harsh"), F.col("prev__km")
    df = df.withColumns({"harsh_increment": _increment("_harsh", before_harsh),
                         "distance_increment": _increment("_km", before_km)})
    return df.withColumn("night_distance_increment", F.col("distance_increment") * F.col("_night")).drop(
        "prev__harsh", "prev__km", "__rn")


def driver_statistics(history: DataFrame, key: str = "Plate", ts: str = "Last_Update",
                      tiebreak: Sequence[str] = (), lookback: int | None = 120) -> DataFrame:
    """G1/Q3: one row of rolling statistics per driver; one shuffle by driver in all."""
    rows = driver_increments(history, key, ts, tiebreak, lookback)
    order = F.struct(ts, *[c for c in tiebreak if c not in (key, ts)])

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), order))

    stats = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"),
        latest("City").alias("latest_city"), latest("Status").alias("latest_status"),
        F.avg("_speed").alias("avg_speed_kmh"),
        F.coalesce(F.stddev_samp("_speed"), F.lit(0.0)).alias("speed_std_kmh"),
        F.max("_speed").alias("max_speed_kmh"),
        F.avg("_accel").alias("avg_acceleration_mps2"),
        F.sum("harsh_increment").alias("harsh_event_total"),
        F.max("_harsh").alias("latest_harsh_event_total"),
        F.avg("_speeding").alias("speeding_event_rate"),
        F.sum("night_distance_increment").alias("night_distance_km"),
        F.sum("distance_increment").alias("trip_distance_km"),
        F.avg("_load").alias("avg_engine_load_pct"),
        F.max("_coolant").alias("max_coolant_temp_c"),
    )
    kept = [key, "observation_count", "window_start", "window_end", "latest_city", "latest_status"]
    return stats.select(*kept, *[half_even(F.col(c), 4).alias(c) for c in stats.schema.names if c not in kept])


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_START = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def trailing_windows(df: DataFrame, key: str, ts: str, row_id: str,
                     measures: Mapping[str, tuple[Column, str]], window_seconds: int,
                     block_seconds: int = HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact trailing time windows ``[t - window, t]`` per key, one result per row id.

    A window is the tail of the block holding its start, the whole blocks between, and
    the head of the block holding its end. Each row asks for the tail by a probe in the
    start block, so tail and head are running aggregates inside (key, block), and the
    whole blocks come from the block totals. In a crowded block the running aggregates stay
    within a part, and the totals of the parts before or after it are added.
    Measures must merge: sum, count, max, min. Repeated row ids give one result each.
    """
    if window_seconds % block_seconds:
        raise ValueError("The window must be a whole number of blocks.")
    width, reach = block_seconds * 1_000_000, window_seconds // block_seconds
    names = list(measures)
    at = _epoch_micros(F.col(ts))
    base = df.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
        key, row_id, at.alias("__t"), *[value.alias(n) for n, (value, _) in measures.items()])
    base = base.withColumn("__home", F.floor(F.col("__t") / F.lit(width)))
    base = base.withColumn("__pos", F.col("__t") - F.col("__home") * F.lit(width))

    asked = base.withColumn("__probe", F.explode(F.array(F.lit(False), F.lit(True))))
    asked = asked.withColumn(
        "__block", F.col("__home") - F.when(F.col("__probe"), F.lit(reach)).otherwise(F.lit(0)))
    values = {n: F.when(~F.col("__probe"), F.col(n)) for n in names}
    asked = asked.withColumns(values)
    asked = _with_parts(asked, key, "__block", "__pos", width, block_rows)
    group = [key, "__block", "__part"]
    unbounded = (Window.unboundedPreceding, Window.currentRow)
    head = Window.partitionBy(*group).orderBy(F.asc("__pos")).rangeBetween(*unbounded)
    tail = Window.partitionBy(*group).orderBy(F.desc("__pos")).rangeBetween(*unbounded)
    asked = asked.withColumns({f"__part_{n}": F.when(F.col("__probe"), _START[how](n).over(tail))
                               .otherwise(_START[how](n).over(head)) for n, (_, how) in measures.items()})
    whole = asked.groupBy(*group).agg(*[_START[how](n).alias(n) for n, (_, how) in measures.items()])
    earlier = Window.partitionBy(key, "__block").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key, "__block").orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    whole = whole.select(*group, *[_MERGE[how](n).over(side).alias(f"__{name}_{n}") for n, (_, how) in measures.items()
                                   for name, side in (("earlier", earlier), ("later", later))])
    asked = asked.join(whole, group)

    def both(how: str, one: Column, other: Column) -> Column:
        if how in ("max", "min"):
            return F.greatest(one, other) if how == "max" else F.least(one, other)
        some = F.when(one.isNotNull() | other.isNotNull(), F.coalesce(one, F.lit(0)) + F.coalesce(other, F.lit(0)))
        return F.coalesce(some, F.lit(0)) if how == "count" else some

    outside = {n: F.when(F.col("__probe"), F.col(f"__later_{n}")).otherwise(F.col(f"__earlier_{n}")) for n in names}
    parts = asked.groupBy(key, "__home", row_id, "__t").agg(
        *[_MERGE[how](both(how, F.col(f"__part_{n}"), outside[n])).alias(f"__part_{n}") for n, (_, how) in measures.items()])

    totals = base.groupBy(key, "__home").agg(*[_START[how](n).alias(n) for n, (_, how) in measures.items()])
    between = Window.partitionBy(key).orderBy("__home").rangeBetween(1 - reach, -1)
    blocks = totals.select(key, "__home", *[
        _MERGE[how](n).over(between).alias(f"__full_{n}") for n, (_, how) in measures.items()])
    joined = parts.join(blocks, [key, "__home"])

    return joined.select(key, row_id, *[both(how, F.col(f"__part_{n}"), F.col(f"__full_{n}")).alias(n)
                                        for n, (_, how) in measures.items()])


def rolling_speed(history: DataFrame, row_id: str, key: str = "Plate", ts: str = "Last_Update") -> DataFrame:
    """Mean speed over the trailing 7 days, per history row."""
    speed = num(history, "Speed_kmh")
    out = trailing_windows(history, key, ts, row_id,
                           {"__sum": (speed, "sum"), "__n": (speed, "count")}, 7 * DAY)
    return out.select(key, row_id, F.try_divide(F.col("__sum"), F.col("__n")).alias("Avg_Speed_Last_7_Days"))


def rolling_harsh(history: DataFrame, row_id: str, key: str = "Plate", ts: str = "Last_Update") -> DataFrame:
    """Harsh events over the trailing 30 days, per history row."""
    harsh = (num(history, "Harsh_Brake_Count", 0.0) + num(history, "Harsh_Accel_Count", 0.0)
             + num(history, "Harsh_Corner_Count", 0.0))
    return trailing_windows(history, key, ts, row_id,
                            {"Total_Harsh_Events_Last_30_Days": (harsh, "sum")}, 30 * DAY)


def trailing_extremes(history: DataFrame, row_id: str, days: int = 30, key: str = "Plate",
                      ts: str = "Last_Update", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximum speed, speed variance and extreme accelerations over the trailing days, per history row.

    The variance comes from sums of the speeds' distances to a whole number near the vehicle's
    mean, so that large speeds of little variance lose no digits.
    """
    speed, accel = num(history, "Speed_kmh"), num(history, "Acceleration_mps2")
    rows = history.select(key, ts, row_id, speed.alias("__speed"), accel.alias("__accel"))
    middle = rows.groupBy(key).agg(F.round(F.avg("__speed")).alias("__middle"))
    rows = rows.join(middle, key)
    off = F.col("__speed") - F.col("__middle")
    out = trailing_windows(rows, key, ts, row_id, {
        "__max": (F.col("__speed"), "max"), "__up": (F.col("__accel"), "max"), "__down": (-F.col("__accel"), "max"),
        "__n": (F.col("__speed"), "count"), "__sum": (off, "sum"), "__squares": (off * off, "sum")}, days * DAY, block_rows=block_rows)
    n, total = F.col("__n"), F.col("__sum")
    variance = F.when(n > 1, F.greatest((F.col("__squares") - total * total / n) / (n - 1), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select(key, row_id, F.col("__max").alias("Max_Speed_kmh"), variance.alias("Speed_Variance"),
                      F.greatest("__up", F.lit(0.0)).alias("Max_Acceleration_mps2"),
                      F.greatest("__down", F.lit(0.0)).alias("Max_Deceleration_mps2"))


def vehicle_windows(history: DataFrame, key: str = "Plate", ts: str = "Last_Update", days: int = 30) -> DataFrame:
    """The trailing windows of each vehicle's last observation, one row per vehicle.

    7-day mean speed, and over ``days`` the harsh events, maximum speed, speed variance and
    extreme accelerations. All are plain aggregates, so a hot vehicle is one row per task.
    """
    harsh = (num(history, "Harsh_Brake_Count", 0.0) + num(history, "Harsh_Accel_Count", 0.0)
             + num(history, "Harsh_Corner_Count", 0.0))
    rows = history.select(key, _epoch_micros(stamp(history, ts)).alias("__t"), num(history, "Speed_kmh").alias("__speed"),
                          num(history, "Acceleration_mps2").alias("__accel"), harsh.alias("__harsh"))
    rows = rows.filter(F.col("__t").isNotNull() & F.col(key).isNotNull())
    last = rows.groupBy(key).agg(F.max("__t").alias("__last"))
    age = (F.col("__last") - F.col("__t")) / F.lit(1_000_000)
    rows = rows.join(last, key).filter(age <= days * DAY)
    return rows.groupBy(key).agg(
        F.avg(F.when(age <= 7 * DAY, F.col("__speed"))).alias("Avg_Speed_Last_7_Days"),
        F.sum("__harsh").alias("Total_Harsh_Events_Last_30_Days"), F.max("__speed").alias("Max_Speed_kmh"),
        F.coalesce(F.var_samp("__speed"), F.lit(0.0)).alias("Speed_Variance"),
        F.greatest(F.max("__accel"), F.lit(0.0)).alias("Max_Acceleration_mps2"),
        F.greatest(F.max(-F.col("__accel")), F.lit(0.0)).alias("Max_Deceleration_mps2"))


def vehicle_extremes(history: DataFrame, key: str = "Plate") -> DataFrame:
    """Observed maximum speed, speed variance and extreme accelerations per vehicle."""
    speed, accel = num(history, "Speed_kmh"), num(history, "Acceleration_mps2")
    return history.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(speed).alias("Max_Speed_kmh"),
        F.coalesce(F.var_samp(speed), F.lit(0.0)).alias("Speed_Variance"),
        F.greatest(F.max(accel), F.lit(0.0)).alias("Max_Acceleration_mps2"),
        F.greatest(F.max(-accel), F.lit(0.0)).alias("Max_Deceleration_mps2"),
    )


def trip_sessions(history: DataFrame, key: str = "Plate", ts: str = "Last_Update",
                  tiebreak: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A trip starts at the step into Driving and lasts while the vehicle drives.

    Hours and distance add up from row to row of the trip (speed over the time since the
    row before).
    """
    df = history.withColumn(ts, stamp(history, ts)).filter(
        F.col(ts).isNotNull() & F.col(key).isNotNull())
    df = df.select(key, ts, *[c for c in tiebreak if c not in (key, ts)],
                   text(df, "Status", "Parked").alias("Status"), num(df, "Speed_kmh", 0.0).alias("_speed"))
    df = df.withColumn("_at", _epoch_micros(F.col(ts)).cast("double") / F.lit(1e6))
    df = _blocked(df, key, ts, DAY, block_rows)
    # Within a block: the row before, and where a trip starts. A block's first row is settled by
    # the block before it, of which one summary row is handed on.
    order = [ts, *tiebreak]
    inside = Window.partitionBy(key, "__block").orderBy(*order)
    driving = F.col("Status") == "Driving"
    df = df.withColumns({"_row": F.row_number().over(inside), "_before": F.lag("Status").over(inside), "_before_at": F.lag("_at").over(inside)})
    inner = (driving & (F.col("_row") > 1) & ~F.coalesce(F.col("_before") == "Driving", F.lit(False))).cast("int")
    df = df.withColumn("_starts", F.sum(inner).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = df.groupBy(key, "__block").agg(
        F.max_by(F.struct("Status", "_at"), "_row").alias("_last"), F.max(F.when(F.col("_row") == 1, F.col("Status"))).alias("_first"),
        F.max("_starts").alias("_inner"))
    sequence = Window.partitionBy(key).orderBy("__block")
    blocks = blocks.withColumn("_carry", F.lag("_last").over(sequence))
    opens = ((F.col("_first") == "Driving") & ~F.coalesce(F.col("_carry.Status") == "Driving", F.lit(False))).cast("int")
    blocks = blocks.withColumn("_opens", opens)
    earlier = F.sum(F.col("_inner") + F.col("_opens")).over(sequence.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(key, "__block", "_carry", (F.coalesce(earlier, F.lit(0)) + F.col("_opens")).alias("_offset"))
    df = df.join(blocks, [key, "__block"]).filter(driving)
    first = F.col("_row") == 1
    before = F.when(first, F.col("_carry.Status")).otherwise(F.col("_before"))
    before_at = F.when(first, F.col("_carry._at")).otherwise(F.col("_before_at"))
    hours = F.when(F.coalesce(before == "Driving", F.lit(False)), (F.col("_at") - before_at) / F.lit(3600.0)).otherwise(F.lit(0.0))
    df = df.withColumns({"_hours": hours, "trip_number": F.col("_offset") + F.col("_starts")})
    return df.groupBy(key, "trip_number").agg(
        F.min(ts).alias("trip_start"), F.max(ts).alias("trip_end"), F.count(F.lit(1)).alias("observations"),
        F.sum("_hours").alias("trip_hours"), F.sum(F.col("_speed") * F.col("_hours")).alias("trip_distance_km"))
