"""Fraud flags, robust anomaly score, layered report and sticky severity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import bound, clip, has, lookup, num, text
from fleetrisk.functions.runtime import settle
from fleetrisk.operators.cleaning import select_existing
from fleetrisk.operators.joins import update_while_driving, with_prior_state
from fleetrisk.operators.pricing import live_policy
from fleetrisk.operators.ranks import column_quantiles, grouped_quantiles

ANOMALY_COLUMNS = ("Risk_Score", "Speeding_Excess_kmh", "Aggressive_Driving_Score", "Total_Distance_Monthly_km")
LAYER_FLAGS = ("Rule_Violation_Flag", "Is_Anomaly", "Fraud_Risk_Flag", "Tampering_Suspected")
LAYER_NAMES = ("Rule", "Anomaly", "Fraud", "Consistency")
KM_PER_DEGREE = 111
SPREAD_LIMIT_KM = 500


def fraud_flags(df: DataFrame) -> DataFrame:
    """A1: hard rules per row, plus the fleet-wide position spread that flags every row."""
    tests = []
    if has(df, "Speed_kmh"):
        tests.append(num(df, "Speed_kmh", 0.0) > 180)
    if has(df, "Acceleration_mps2"):
        tests.append(F.abs(num(df, "Acceleration_mps2", 0.0)) > 7)
    if has(df, "Battery_V"):
        volts = num(df, "Battery_V", 12.6)
        tests.append((volts < 10.5) | (volts > 15.0))
    if has(df, "GPS_Latitude") and has(df, "GPS_Longitude"):
        wide = [(F.max(num(df, c)) - F.min(num(df, c))) * F.lit(KM_PER_DEGREE) > SPREAD_LIMIT_KM
                for c in ("GPS_Latitude", "GPS_Longitude")]
        tests.append(df.agg(F.coalesce(wide[0] | wide[1], F.lit(False))).scalar())
    flagged = F.lit(False)
    for test in tests:
        flagged = flagged | test
    return df.withColumn("Fraud_Flag", flagged.cast("int"))


def fraud_table(df: DataFrame) -> DataFrame:
    """A2: flagged rows with their severity."""
    flagged = fraud_flags(df).filter("Fraud_Flag = 1")
    critical = (num(df, "Speed_kmh") > 180) | (F.abs(num(df, "Acceleration_mps2")) > 7)
    columns = ("Plate", "Speed_kmh", "Acceleration_mps2", "Battery_V", "Trip_Distance_km")
    flagged = flagged.withColumn("Severity", F.when(critical, "Critical").otherwise("Medium"))
    return select_existing(flagged, (*columns, "Severity"))


def fraud_table_or_status(df: DataFrame) -> DataFrame:
    """A2 for display: the table with a ``Status`` column, or one status row when it is empty."""
    table = fraud_table(df).withColumn("Status", F.lit(None).cast("string"))
    clear = table.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("No fraud detected").alias("Status"))
    return table.unionByName(clear, allowMissingColumns=True)


def _driving(df: DataFrame) -> Column:
    return F.lower(text(df, "Status", "Parked")) == "driving"


def impute_driving_telemetry(df: DataFrame) -> DataFrame:
    """Telemetry missing on driving rows is estimated from the risk score; ranges are enforced."""
    driving, score = _driving(df), num(df, "Risk_Score", 0.5)

    def filled(name: str, base: float, slope: float, low: float | None, high: float | None) -> Column:
        guess = F.when(driving, F.lit(base) + score * F.lit(slope))
        return clip(F.coalesce(num(df, name), guess), low, high)

    df = df.withColumns({
        "Status": text(df, "Status", "Parked"),
        "Speed_kmh": filled("Speed_kmh", 40.0, 60.0, 0.0, 300.0),
        "Aggressive_Driving_Score": filled("Aggressive_Driving_Score", 0.05, 0.6, 0.0, 1.0),
        "Total_Distance_Monthly_km": filled("Total_Distance_Monthly_km", 200.0, 800.0, 0.0, None),
        "RPM": filled("RPM", 800.0, 2500.0, 0.0, 7000.0),
        "Engine_Load_pct": filled("Engine_Load_pct", 20.0, 50.0, 0.0, 100.0),
    })
    excess = clip(F.col("Speed_kmh") - num(df, "Speed_Limit_kmh", 50.0), low=0.0)
    guess = F.when(_driving(df), expected_maf(df))
    return df.withColumns({
        "Speeding_Excess_kmh": excess,
        "MAF_gs": clip(F.coalesce(num(df, "MAF_gs"), guess), low=0.0),
    })


def expected_maf(df: DataFrame) -> Column:
    return (F.lit(5.0) + F.col("Engine_Load_pct") / F.lit(100.0) * F.lit(120.0)
            + F.col("RPM") / F.lit(7000.0) * F.lit(30.0))


def rule_layer(df: DataFrame) -> DataFrame:
    """A3: speeding rules; a parked row keeps the flag it came with."""
    speed, excess = F.col("Speed_kmh"), F.col("Speeding_Excess_kmh")
    fast, over = F.coalesce(speed > 250, F.lit(False)), F.coalesce(excess > 50, F.lit(False))
    flag = fast | over | (F.coalesce(speed > 120, F.lit(False)) & _driving(df))
    if has(df, "Speeding_Flag"):
        kept = num(df, "Speeding_Flag", 0.0).cast("int") == 1
        flag = F.when(_driving(df), flag).otherwise(kept)
    reason = (F.when(fast, "Speed exceeds 250 km/h").when(over, "Speed exceeds road limit by >50 km/h")
              .otherwise("None"))
    df = df.withColumn("Speeding_Flag", flag)
    df = df.withColumn("Rule_Violation_Flag", fast | over | F.col("Speeding_Flag"))
    return df.withColumn("Rule_Violation_Reason", F.when(F.col("Rule_Violation_Flag"), reason).otherwise("None"))


def fit_robust(df: DataFrame, columns: Sequence[str] = ANOMALY_COLUMNS) -> dict[str, tuple]:
    """Median, MAD, mean and population std of each column, as plain numbers.

    The order statistics are exact and distributed; what reaches the driver is one row.
    """
    columns = [c for c in columns if has(df, c)]
    rows = df.select(*[num(df, c).alias(c) for c in columns])
    middle = column_quantiles(rows, columns, {"median": 0.5}).first()
    middle = [middle[f"{c}__median"] if middle else None for c in columns]
    deviation = rows.select(*[F.abs(F.col(c) - F.lit(m).cast("double")).alias(c) for c, m in zip(columns, middle)])
    mad = column_quantiles(deviation, columns, {"mad": 0.5}).first()
    mad = [mad[f"{c}__mad"] if mad else None for c in columns]
    moments = rows.agg(*[F.struct(F.avg(c), F.stddev_pop(c)) for c in columns]).first()
    return {c: (m, d, *moments[i]) for i, (c, m, d) in enumerate(zip(columns, middle, mad))}


def robust_z(df: DataFrame, columns: Sequence[str] = ANOMALY_COLUMNS) -> DataFrame:
    """A4: ``z_<column>``: distance from the median in MAD units.

    Without a MAD the plain z-score is used, and without any spread zero.
    """
    out = {}
    for c, (median, mad, mean, std) in fit_robust(df, columns).items():
        if mad:
            z = (num(df, c) - F.lit(float(median))) / (F.lit(1.4826) * F.lit(float(mad)))
        elif std:
            z = (num(df, c) - F.lit(float(mean))) / F.lit(float(std))
        else:
            z = F.lit(0.0)
        out[f"z_{c}"] = F.coalesce(z, F.lit(0.0))
    return df.withColumns(out)


def anomaly_layer(df: DataFrame, columns: Sequence[str] = ANOMALY_COLUMNS) -> DataFrame:
    """A5: mean absolute z over its 95th percentile, 0..1, flagged above 0.6."""
    used = [c for c in columns if has(df, c)]
    if not used:
        return df.withColumns({"Anomaly_Score": F.lit(0.0), "Is_Anomaly": F.lit(False)})
    df = robust_z(df, used)
    raw = sum((F.abs(F.col(f"z_{c}")) for c in used[1:]), F.abs(F.col(f"z_{used[0]}"))) / F.lit(float(len(used)))
    df = df.withColumn("__raw", raw).drop(*[f"z_{c}" for c in used])
    cap = grouped_quantiles(df.select("__raw"), "__raw", {"cap": 0.95}).first()
    cap = cap["cap"] if cap and cap["cap"] and cap["cap"] > 0 else 1.0
    df = df.withColumn("Anomaly_Score", bound(F.col("__raw") / F.lit(float(cap)), 0.0, 1.0)).drop("__raw")
    return df.withColumn("Is_Anomaly", F.col("Anomaly_Score") > 0.6)


def probability_layer(df: DataFrame) -> DataFrame:
    """Supplied fraud score, else the risk score; flagged above 0.7."""
    value = num(df, "Risk_Score")
    if has(df, "Fraud_Risk_Score"):
        value = F.coalesce(num(df, "Fraud_Risk_Score"), value)
    df = df.withColumn("Fraud_Probability", clip(value, 0.0, 1.0))
    return df.withColumn("Fraud_Risk_Flag", F.coalesce(F.col("Fraud_Probability") > 0.7, F.lit(False)))


def consistency_layer(df: DataFrame) -> DataFrame:
    """Agreement of air flow with load and engine speed; under 0.6 suggests tampering."""
    maf, load, rpm = num(df, "MAF_gs"), num(df, "Engine_Load_pct"), num(df, "RPM")
    expected = F.lit(5.0) + load / F.lit(100.0) * F.lit(120.0) + rpm / F.lit(7000.0) * F.lit(30.0)
    df = df.withColumn("__expected", expected)
    gap = F.abs(maf - F.col("__expected")) / F.greatest(F.col("__expected"), F.lit(1.0))
    score = F.when(maf.isNotNull() & F.col("__expected").isNotNull(), F.lit(1.0) - F.least(gap, F.lit(1.0)))
    df = df.withColumn("Data_Consistency_Score", bound(F.coalesce(score, F.lit(0.5)), 0.0, 1.0)).drop("__expected")
    return df.withColumn("Tampering_Suspected", F.col("Data_Consistency_Score") < 0.6)


def composite_severity(df: DataFrame) -> DataFrame:
    """Weighted composite and the candidate severity."""
    layers = sum((F.col(c).cast("int") for c in LAYER_FLAGS[1:]), F.col(LAYER_FLAGS[0]).cast("int"))
    anyone = F.col(LAYER_FLAGS[0])
    for flag in LAYER_FLAGS[1:]:
        anyone = anyone | F.col(flag)
    score = bound(
        F.lit(0.6) * F.coalesce(F.col("Fraud_Probability"), F.lit(0.0))
        + F.lit(0.25) * (layers.cast("double") / F.lit(4.0)) + F.lit(0.15) * F.col("Anomaly_Score"), 0.0, 1.0)
    df = df.withColumns({"Overall_Fraud_Flag": anyone, "Composite_Score": score})
    score = F.col("Composite_Score")
    return df.withColumn("Candidate_Severity", F.when(score >= 0.85, "Critical").when(score >= 0.70, "High")
                         .when(score >= 0.45, "Medium").otherwise("Low"))


def hold_hours(df: DataFrame, level: Column) -> Column:
    """Hours a level is held: a positive per-row override, else by level."""
    if has(df, "Severity_Hold_Hours"):
        own = num(df, "Severity_Hold_Hours")
    elif has(df, "Severity_Hold_Days"):
        own = num(df, "Severity_Hold_Days") * F.lit(24.0)
    else:
        own = F.lit(None).cast("double")
    return F.when(own > 0, own).otherwise(lookup(K.SEVERITY_HOLD_HOURS, level, 24.0))


def sticky_severity(df: DataFrame, as_of: datetime, state: DataFrame | None = None) -> DataFrame:
    """Keep the stored severity until its hold time has passed.

    Adds ``Severity``, and ``State_Updated`` / ``State_Composite`` for the next state.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    candidate = F.col("Candidate_Severity")
    if state is None:
        return df.withColumns({"Severity": candidate, "State_Updated": now,
                               "State_Composite": F.col("Composite_Score")})
    df = with_prior_state(df, state)
    updated = F.col("prior_updated").cast("timestamp_ntz")
    elapsed = F.timestamp_diff("MICROSECOND", updated, now) / F.lit(3_600_000_000.0)
    level = F.coalesce(F.col("prior_severity"), candidate)
    held = F.coalesce(elapsed < hold_hours(df, level), F.lit(False))
    df = df.withColumn("__held", held)
    held = F.col("__held")
    return df.withColumns({
        "Severity": F.when(held, level).otherwise(candidate),
        "State_Updated": F.when(held, updated).otherwise(now),
        "State_Composite": F.when(held, F.col("prior_composite")).otherwise(F.col("Composite_Score")),
    }).drop("__held", "prior_severity", "prior_updated", "prior_composite")


def next_state(result: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state table after a report: updated plates, and stored plates that were not seen."""
    order = F.struct("State_Updated", "State_Composite")
    fresh = result.groupBy(F.col("Plate").cast("string").alias("plate")).agg(
        F.max_by("Severity", order).alias("severity"), F.max("State_Updated").alias("last_updated"),
        F.max_by("State_Composite", order).alias("composite_score"))
    if state is None:
        return fresh
    unseen = state.select("plate", "severity", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"),
                          "composite_score").join(fresh.select("plate"), "plate", "left_anti")
    return fresh.unionByName(unseen)


def commit_severities(df: DataFrame, as_of: datetime, table) -> DataFrame:
    """A9 with its state table (``sources.io.StateTable``): the severities of a round, after their state is committed.

    The round reads the current state, and commits the next one in its place; if another round
    did so in the meantime, the table raises a conflict and nothing is changed.
    """
    state = table.read()
    result = settle(sticky_severity(df, as_of, state), "severities")
    table.replace(next_state(result, state))
    return result


def label_severity(df: DataFrame, as_of: datetime) -> DataFrame:
    """A10: colour, fraud type, action, time, and the list of triggered layers."""
    level = F.col("Severity")
    layers = F.concat_ws(",", *[F.when(F.col(flag), F.lit(name)) for flag, name in zip(LAYER_FLAGS, LAYER_NAMES)])
    action = lookup(K.SEVERITY_ACTION, level, K.SEVERITY_ACTION["Low"])
    return df.withColumns({
        "Fraud_Severity": level, "Colour": lookup(K.SEVERITY_COLOUR, level, "Green"),
        "Fraud_Types_Included": lookup(K.SEVERITY_FRAUD_TYPE, level, K.SEVERITY_FRAUD_TYPE["Low"]),
        "Action": action, "Recommended_Action": action,
        "Timestamp": F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")),
        "Detection_Layers_Triggered": F.when(layers == "", "None").otherwise(layers),
    })


def assessed_vehicles(df: DataFrame, as_of: datetime, state: DataFrame | None = None,
                      schedule_scores: DataFrame | None = None, checkpoint: bool = True) -> DataFrame:
    """A3-A10 on every vehicle.

    The imputed telemetry is settled once as a table in the shared folder, because the
    medians, deviations and percentiles of the robust statistics each read it again.
    """
    df = live_policy(df)
    if schedule_scores is not None:
        df = update_while_driving(df, schedule_scores)
    df = impute_driving_telemetry(df)
    if checkpoint:
        df = settle(df)
    df = consistency_layer(probability_layer(anomaly_layer(rule_layer(df))))
    return label_severity(sticky_severity(composite_severity(df), as_of, state), as_of)


def flagged_report(df: DataFrame, as_of: datetime, state: DataFrame | None = None, **options) -> DataFrame:
    """The flagged vehicles with the 23 report columns, ordered by plate."""
    assessed = assessed_vehicles(df, as_of, state, **options)
    return select_existing(assessed.filter("Overall_Fraud_Flag"), K.FLAGGED_COLUMNS).orderBy("Plate")
