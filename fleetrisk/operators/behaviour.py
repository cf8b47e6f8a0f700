"""Behaviour statistics, histograms, heatmaps and trends."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import existing, has, num, round_columns, stamp
from fleetrisk.operators.ranks import column_quantiles, grouped_quantiles, scalar_row

BEHAVIOUR_METRICS = ("Speed_kmh", "Recent_Harsh_Events", "RPM", "Engine_Load_pct")
_HARSH = (("Harsh_Brake_Count", "Harsh Braking"), ("Harsh_Accel_Count", "Harsh Acceleration"),
          ("Harsh_Corner_Count", "Harsh Cornering"))


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of ``y`` by ``x``, in the order of ``x``."""
    return df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.avg(y).alias(y)).orderBy(x)


def corrected_skew(value: Column) -> Column:
    """Bias-corrected skewness; fewer than three values give NULL, no spread gives zero."""
    n = F.count(value).cast("double")
    raw = F.coalesce(F.nullif(F.skewness(value), F.lit(float("nan"))), F.lit(0.0))
    return F.when(n >= 3, raw * F.sqrt(n * (n - F.lit(1.0))) / (n - F.lit(2.0)))


def behaviour_by_type(df: DataFrame, key: str = "Type", metrics: Sequence[str] = BEHAVIOUR_METRICS) -> DataFrame:
    """Mean, median, std and skew of each metric per vehicle type; 2 decimals."""
    metrics = existing(df, metrics)
    rows = df.filter(F.col(key).isNotNull()).select(key, *[num(df, m).alias(m) for m in metrics])
    aggs = []
    for m in metrics:
        value = F.col(m)
        aggs += [F.avg(value).alias(f"{m}_mean"), F.stddev_samp(value).alias(f"{m}_std"),
                 corrected_skew(value).alias(f"{m}_skew")]
    moments = rows.groupBy(key).agg(*aggs)
    medians = column_quantiles(rows, metrics, {"median": 0.5}, [key])
    medians = medians.toDF(*[c.replace("__median", "_median") for c in medians.columns])
    out = moments.join(medians, key, "left")
    return round_columns(out, {c: 2 for c in out.schema.names if c != key})


def harsh_totals(df: DataFrame) -> DataFrame:
    """Total per harsh event type."""
    row = df.agg(*[F.coalesce(F.sum(num(df, c)), F.lit(0.0)).cast("long").alias(c) for c, _ in _HARSH])
    cells = F.array(*[F.struct(F.lit(label).alias("Event_Type"), F.col(c).alias("Count")) for c, label in _HARSH])
    return row.select(F.inline(cells))


def harsh_by_type(df: DataFrame, key: str = "Type") -> DataFrame:
    """Mean harsh counts per vehicle type."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(*[F.avg(num(df, c)).alias(c) for c, _ in _HARSH]).orderBy(key))


def exploded_counts(df: DataFrame, column: str, item: str = "Fraud_Type") -> DataFrame:
    """Counts of the items of a comma-separated column; a blank item is Unknown."""
    items = df.filter(F.col(column).isNotNull()).select(F.explode(F.split(column, ",")).alias(item))
    name = F.trim(item)
    named = items.select(F.when(name == "", "Unknown").otherwise(name).alias(item))
    return named.groupBy(item).agg(F.count(F.lit(1)).alias("Count")).orderBy(F.desc("Count"), F.asc(item))


def _span(df: DataFrame, value: str) -> Column:
    """Minimum and maximum as a scalar struct, widened by half a unit when they are equal."""
    lo, hi = F.min(value), F.max(value)
    pad = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
    return df.agg(F.struct((lo - pad).alias("lo"), (hi + pad).alias("hi")).alias("span")).scalar()


def _edge(span: Column, i: Column, bins: int) -> Column:
    step = (span.getField("hi") - span.getField("lo")) / F.lit(float(bins))
    return F.when(i == bins, span.getField("hi")).otherwise(span.getField("lo") + i.cast("double") * step)


def _bin_index(value: Column, span: Column, bins: int, right_closed: bool) -> Column:
    """Equal-width bin number; the quotient is corrected against the real edges."""
    step = (span.getField("hi") - span.getField("lo")) / F.lit(float(bins))
    quotient = (value - span.getField("lo")) / step
    guess = (F.ceil(quotient) - F.lit(1)) if right_closed else F.floor(quotient)
    guess = F.greatest(F.least(guess, F.lit(bins - 1)), F.lit(0)).cast("int")
    below, above = _edge(span, guess, bins), _edge(span, guess + F.lit(1), bins)
    if right_closed:
        fixed = F.when(value <= below, guess - F.lit(1)).when(value > above, guess + F.lit(1))
    else:
        fixed = F.when(value < below, guess - F.lit(1)).when(value >= above, guess + F.lit(1))
    return F.greatest(F.least(fixed.otherwise(guess), F.lit(bins - 1)), F.lit(0))


def harsh_speed_heatmap(df: DataFrame, speed_bins: int = 8, how: str = "Count") -> DataFrame:
    """Capped harsh count by equal-width speed bin, with every cell of the grid.

    Bins are right-closed and the lowest edge belongs to the first bin.
    """
    score = next((c for c in ("Calculated_Risk_Score", "Risk_Score", "Fraud_Probability") if has(df, c)), None)
    mean = how == "Mean Risk Score" and score is not None
    rows = df.select(
        num(df, "Recent_Avg_Speed").alias("speed"),
        num(df, "Recent_Harsh_Events", 0.0).cast("int").alias("harsh"),
        (num(df, score) if mean else F.lit(None).cast("double")).alias("score"),
    ).filter(F.col("speed").isNotNull())
    facts = {"__span": _span(rows, "speed"), "__top": rows.agg(F.least(F.max("harsh"), F.lit(10))).scalar()}
    span, top = F.col("__span"), F.col("__top")
    cells = rows.withColumns(facts).select(
        F.least("harsh", top).alias("Harsh_Capped"),
        _bin_index(F.col("speed"), span, speed_bins, right_closed=True).alias("Speed_Bin"), "score")
    measure = F.avg("score").alias("Value") if mean else F.count(F.lit(1)).alias("Value")
    counts = cells.groupBy("Harsh_Capped", "Speed_Bin").agg(measure)
    grid = (rows.agg(F.least(F.max("harsh"), F.lit(10)).alias("top")).filter(F.col("top").isNotNull())
            .select(F.explode(F.sequence(F.lit(0), "top")).alias("Harsh_Capped"))
            .select("Harsh_Capped", F.explode(F.sequence(F.lit(0), F.lit(speed_bins - 1))).alias("Speed_Bin")))
    out = grid.join(counts, ["Harsh_Capped", "Speed_Bin"], "left").withColumn("__span", facts["__span"])
    i = F.col("Speed_Bin")
    value = F.col("Value") if mean else F.coalesce(F.col("Value"), F.lit(0))
    low, high = _edge(span, i, speed_bins), _edge(span, i + F.lit(1), speed_bins)
    a, b = F.rint(low).cast("int").cast("string"), F.rint(high).cast("int").cast("string")
    label = F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))
    return out.select("Harsh_Capped", "Speed_Bin", label.alias("Speed_Label"), value.alias("Value"))


SPEED_EDGES = (0, 20, 40, 60, 80, 100, 1000)
SPEED_LABELS = ("0-20", "20-40", "40-60", "60-80", "80-100", "100+")


def hour_speed_heatmap(df: DataFrame, ts: str = "Last_Update") -> DataFrame:
    """Counts by hour of day and fixed speed bin, all 24 hours."""
    rows = df.select(F.hour(stamp(df, ts)).alias("hour"), num(df, "Speed_kmh").alias("speed"))
    rows = rows.filter(F.col("hour").isNotNull() & F.col("speed").isNotNull())
    speed = F.col("speed")
    cells = []
    for i, label in enumerate(SPEED_LABELS):
        low, high = SPEED_EDGES[i], SPEED_EDGES[i + 1]
        inside = ((speed >= low) if i == 0 else (speed > low)) & (speed <= high)
        cells.append(F.count(F.when(inside, F.lit(1))).alias(label))
    counts = rows.groupBy("hour").agg(*cells)
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in SPEED_LABELS]
    return hours.join(counts, "hour", "left").select("hour", *filled).orderBy("hour")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width, left-closed bins (the last also holds its right edge), with centres."""
    rows = df.select(num(df, column).alias("value")).filter(F.col("value").isNotNull())
    facts, span = _span(rows, "value"), F.col("__span")
    counts = rows.withColumn("__span", facts).select(_bin_index(F.col("value"), span, bins, right_closed=False).alias("Bin")).groupBy("Bin").agg(
        F.count(F.lit(1)).alias("Count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("Bin"))
    i = F.col("Bin")
    centre = (_edge(span, i, bins) + _edge(span, i + F.lit(1), bins)) / F.lit(2.0)
    return (grid.join(counts, "Bin", "left").withColumn("__span", facts)
            .select("Bin", centre.alias("Centre"), F.coalesce("Count", F.lit(0)).alias("Count")).orderBy("Bin"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max; 2 decimals."""
    rows = df.select(num(df, column).alias("value")).filter(F.col("value").isNotNull())
    row = rows.agg(F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
                   F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = scalar_row(grouped_quantiles(rows, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    out = row.withColumn("__q", quartiles).select("*", "__q.*").drop("__q")
    return round_columns(out, {c: 2 for c in out.schema.names})


def correlation_matrix(df: DataFrame, columns: Sequence[str] = K.CORRELATION_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form, all pairs in one pass."""
    columns = existing(df, columns)
    rows = df.select(*[num(df, c).alias(c) for c in columns])
    pairs = [(c, c) for c in columns] + list(combinations(columns, 2))
    row = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        value = F.coalesce(F.nullif(F.col(f"c{i}"), F.lit(float("nan"))), F.lit(0.0)).alias("correlation")
        cells.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"), value))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("feature_x"), F.lit(a).alias("feature_y"), value))
    return row.select(F.inline(F.array(*cells)))


def premium_trend_lines(df: DataFrame) -> DataFrame:
    """Least-squares line of premium on risk score per band."""
    y, x = F.col("Monthly_Premium_USD"), F.col("Calculated_Risk_Score")
    paired = y.isNotNull() & x.isNotNull() & F.col("Risk_Band").isNotNull()
    return df.groupBy("Risk_Band").agg(
        F.count(F.when(paired, F.lit(1))).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).filter("n > 0")


def speed_trend(df: DataFrame, ts: str = "Last_Update") -> DataFrame:
    """Fleet mean speed by half hour, hour or half day, chosen by the time span."""
    rows = df.select(stamp(df, ts).cast("timestamp_ntz").alias("at"), num(df, "Speed_kmh").alias("speed"))
    rows = rows.filter(F.col("at").isNotNull() & F.col("speed").isNotNull())
    micros = F.timestamp_diff("MICROSECOND", F.min("at"), F.max("at"))
    hours = micros / F.lit(3_600_000_000.0)
    width = rows.agg(F.when(hours > 72, 43200).when(hours > 24, 3600).otherwise(1800)).scalar()
    second = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at").cast("int")
    start = F.timestamp_add("SECOND", (F.floor(second / width) * width).cast("int"),
                            F.date_trunc("DAY", "at").cast("timestamp_ntz"))
    return rows.groupBy(start.alias("Last_Update")).agg(F.avg("speed").alias("Speed_kmh")).orderBy("Last_Update")


def category(df: DataFrame) -> str:
    """The column that holds the vehicle type."""
    return "Vehicle_Type" if has(df, "Vehicle_Type") else "Type"

