"""Feature engineering (C3-C25): snapshot defaults, engineered columns, risk features."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import calendar as cal
from fleetrisk.functions import risk
from fleetrisk.functions.columns import Presence, bound, clip, half_even, has, lookup, num, stamp, text
from fleetrisk.operators.cleaning import fill_plates
from fleetrisk.operators.drivers import vehicle_windows

# (column, default) of the snapshot columns whose default is a constant.
_TEXT_DEFAULTS = (
    ("Type", "Sedan"), ("Make", "Unknown"), ("Model", "Unknown"), ("Class", "Unknown"),
    ("City", K.DEFAULT_CITY), ("Usage", "Private"), ("Policy_Status", "Active"),
    ("Premium_Payment_Status", "Paid"), ("Road_Type", "Urban"), ("Weather", "Sunny"),
    ("Status", "Parked"), ("Direction", "North"),
)
_NUMBER_DEFAULTS = (
    ("Base_Price_USD", 600.0), ("Trip_Distance_km", 0.0), ("Trip_Duration_Hour", 0.0),
    ("Speed_kmh", 0.0), ("Acceleration_mps2", 0.0), ("RPM", 700.0), ("Throttle_pct", 0.0),
    ("Engine_Load_pct", 5.0), ("Coolant_Temp_C", 75.0), ("MAF_gs", 1.0), ("Battery_V", 12.6),
    ("Fuel_Efficiency_L_per_100km", 8.5),
)
_COUNT_DEFAULTS = (
    ("Engine_CC", 1500), ("Harsh_Brake_Count", 0), ("Harsh_Accel_Count", 0),
    ("Harsh_Corner_Count", 0), ("Speeding_Flag", 0),
)


def _centroid(city: Column, axis: int) -> Column:
    table = {name: point[axis] for name, point in K.CITY_CENTROIDS.items()}
    return lookup(table, city, K.CITY_CENTROIDS[K.DEFAULT_CITY][axis])


def _whole(value: Column) -> Column:
    return value.cast("int")


def _as_date(df: DataFrame, name: str) -> Column:
    if not has(df, name):
        return F.lit(None).cast("date")
    col = F.col(name)
    return col.try_cast("date") if df.schema[name].dataType.simpleString() == "string" else col.cast("date")


def fill_snapshot(df: DataFrame, as_of: datetime, order_by: str | None = None,
                  plates_known: bool = False) -> DataFrame:
    """Every snapshot column present and filled with its default.

    ``as_of`` is the run time in the fleet's local wall clock. ``plates_known`` says
    that the key is never empty, which saves the search for rows to number.
    """
    if not plates_known:
        df = fill_plates(df, order_by=order_by)
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.lit(as_of.date() - timedelta(days=120))
    end = F.lit(as_of.date() + timedelta(days=245))
    cols: dict[str, Column] = {name: text(df, name, default) for name, default in _TEXT_DEFAULTS}
    cols.update({name: num(df, name, default) for name, default in _NUMBER_DEFAULTS})
    cols.update({name: _whole(num(df, name, default)) for name, default in _COUNT_DEFAULTS})
    cols["Year"] = _whole(num(df, "Year", as_of.year))
    cols["Policy_Start_Date"] = F.coalesce(_as_date(df, "Policy_Start_Date"), start)
    cols["Effective_Date"] = F.coalesce(_as_date(df, "Effective_Date"), _as_date(df, "Policy_Start_Date"), start)
    cols["Policy_End_Date"] = F.coalesce(_as_date(df, "Policy_End_Date"), end)
    cols["Expiry_Date"] = F.coalesce(_as_date(df, "Expiry_Date"), _as_date(df, "Policy_End_Date"), end)
    cols["Outstanding_Balance"] = half_even(bound(num(df, "Outstanding_Balance", 0.0), low=0.0), 2)
    cols["Trip_ID"] = F.coalesce(
        text(df, "Trip_ID"), F.concat(F.lit("IDLE-"), F.col("Plate"), F.lit(f"-{as_of:%H%M%S}")))
    city = text(df, "City", K.DEFAULT_CITY)
    cols["GPS_Latitude"] = num(df, "GPS_Latitude", _centroid(city, 0))
    cols["GPS_Longitude"] = num(df, "GPS_Longitude", _centroid(city, 1))
    parts = ("Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count")
    total = sum((cols[name] for name in parts[1:]), cols[parts[0]])
    cols["Total_Harsh_Events_per_Day"] = _whole(
        F.coalesce(num(df, "Total_Harsh_Events_per_Day"), total.cast("double")))
    for name in ("Last_Update", "Status_Change_Timestamp"):
        cols[name] = F.coalesce(stamp(df, name).cast("timestamp_ntz"), now)
    cols["Time_of_Day"] = F.coalesce(text(df, "Time_of_Day"), cal.time_of_day(now))
    cols["Day_of_Week"] = F.coalesce(text(df, "Day_of_Week"), cal.day_name(now))
    return df.withColumns(cols)


# --- C7-C22: one expression per engineered feature, over the raw snapshot ---

def vehicle_age(df: DataFrame, model_year: int = K.FLEET_MODEL_YEAR) -> Column:
    """C8"""
    return bound(F.lit(float(model_year)) - num(df, "Year", model_year), low=0.0)


def road_one_hot(df: DataFrame, road: str) -> Column:
    """C9"""
    return F.coalesce(text(df, "Road_Type") == road, F.lit(False)).cast("double")


def road_limit(df: DataFrame) -> Column:
    """C10"""
    return lookup(K.ROAD_MAX_SPEED, text(df, "Road_Type"), 80.0)


def speeding_excess(df: DataFrame, limit: Column) -> Column:
    """C11"""
    return bound(num(df, "Speed_kmh", 0.0) - limit, low=0.0)


def recent_harsh(df: DataFrame) -> Column:
    """C12"""
    total = (num(df, "Harsh_Brake_Count", 0.0) + num(df, "Harsh_Accel_Count", 0.0)
             + num(df, "Harsh_Corner_Count", 0.0))
    return bound(total, 0.0, 10.0)


def recent_avg_speed(df: DataFrame) -> Column:
    """C12"""
    return bound(num(df, "Speed_kmh", 0.0) * F.lit(0.95), 0.0, 180.0)


def speeding_ratio(df: DataFrame) -> Column:
    """Speeding flags per 100 km, zero without distance."""
    km = num(df, "Trip_Distance_km", 0.0)
    return F.when(km > 0, num(df, "Speeding_Flag", 0.0) / (km / F.lit(100.0))).otherwise(F.lit(0.0))


def night_distance(df: DataFrame, night: Column) -> Column:
    """C14"""
    return num(df, "Trip_Distance_km", 0.0) * F.when(night == 1, F.lit(0.45)).otherwise(F.lit(0.08))


def speeding_night_interaction(excess: Column, limit: Column, night: Column) -> Column:
    """C16"""
    share = F.when(limit > 0, bound(F.try_divide(excess, limit), 0.0, 1.0)).otherwise(F.lit(0.0))
    return share * night.cast("double")


def battery_health(df: DataFrame) -> Column:
    """C17"""
    return bound((num(df, "Battery_V", 12.6) - F.lit(11.5)) * F.lit(50.0), 0.0, 100.0)


def weather_factor(df: DataFrame) -> Column:
    """C18"""
    return lookup(K.WEATHER_FACTOR, text(df, "Weather"), 1.0)


def driving_event_score(harsh: Column, speeding_flag: Column) -> Column:
    """C19"""
    return bound(F.lit(0.25) * (harsh / F.lit(5.0)) + F.lit(0.25) * speeding_flag, 0.0, 1.0)


def aggressive_score(harsh: Column, speeding_flag: Column, acceleration: Column) -> Column:
    """C20"""
    return bound(F.lit(0.35) * (harsh / F.lit(5.0)) + F.lit(0.35) * speeding_flag
                 + F.lit(0.30) * bound(F.abs(acceleration) / F.lit(6.0), 0.0, 1.0), 0.0, 1.0)


def fatigue_score(df: DataFrame, night: Column) -> Column:
    """C21"""
    weekend = F.coalesce(text(df, "Day_of_Week").isin(*K.WEEKEND_DAYS), F.lit(False)).cast("double")
    hours = bound(num(df, "Trip_Duration_Hour", 0.0) / F.lit(5.0), high=1.0)
    return bound(F.lit(0.4) * night.cast("double") + F.lit(0.2) * hours + F.lit(0.2) * weekend, 0.0, 1.0)


def coolant_overheat(df: DataFrame) -> Column:
    """C22"""
    return (num(df, "Coolant_Temp_C", 0.0) > 95.0).cast("int")


def preprocess(raw: DataFrame, as_of: datetime, order_by: str | None = None,
               plates_known: bool = False, model_year: int = K.FLEET_MODEL_YEAR,
               history: DataFrame | None = None) -> DataFrame:
    """Raw snapshot to the engineered snapshot, in three projections.

    The features read the raw values (each with its own default) before the snapshot
    defaults are filled in. With a ``history`` the trailing windows (7-day mean speed, 30-day
    harsh events, speed and acceleration extremes, speed variance) are those of the vehicle's last
    observation there (``drivers.vehicle_windows``). Vehicles without one, and calls without a
    history, get single-snapshot stand-ins.
    """
    stale = [c for c in ("Harsh_Events_Per_Km", "Calculated_Risk_Score", "Risk_Band", "Monthly_Premium_USD")
             if has(raw, c)]
    df = raw.drop(*stale)
    acceleration = num(df, "Acceleration_mps2", 0.0)
    speeding_flag = num(df, "Speeding_Flag", 0.0)
    first = {
        "Night_Driving_Flag": cal.night_flag(text(df, "Time_of_Day")),
        "Vehicle_Age_Years": vehicle_age(df, model_year),
        "Potholed_Ratio": road_one_hot(df, "Potholed"), "Gravel_Ratio": road_one_hot(df, "Gravel"),
        "Highway_Ratio": road_one_hot(df, "Highway"), "Urban_Ratio": road_one_hot(df, "Urban"),
        "Base_Road_Max_Speed_kmh": road_limit(df),
        "Recent_Harsh_Events": recent_harsh(df), "Recent_Avg_Speed": recent_avg_speed(df),
        "Recent_Speeding_Ratio": speeding_ratio(df),
        "Battery_Health_Score": battery_health(df), "Weather_Risk_Score": weather_factor(df),
        "Coolant_Overheat_Flag": coolant_overheat(df),
        "Max_Speed_kmh": num(df, "Speed_kmh", 0.0), "Speed_Variance": F.lit(0.0),
        "Max_Acceleration_mps2": bound(F.abs(acceleration), 0.0, 6.0),
        "Max_Deceleration_mps2": bound(F.abs(acceleration) * F.lit(0.6), 0.0, 6.0),
        "Trip_Duration_Minutes": num(df, "Trip_Duration_Minutes", 0.0),
        **cal.stamp_parts(F.coalesce(stamp(df, "Last_Update").cast("timestamp_ntz"),
                                     F.lit(as_of).cast("timestamp_ntz"))),
    }
    df = df.withColumns(first)
    night, harsh = F.col("Night_Driving_Flag"), F.col("Recent_Harsh_Events")
    limit = F.col("Base_Road_Max_Speed_kmh")
    df = df.withColumns({
        "Speeding_Excess_kmh": speeding_excess(df, limit),
        "Recent_Night_Distance": night_distance(df, night),
        "Avg_Speed_Last_7_Days": F.col("Recent_Avg_Speed"),
        "Total_Harsh_Events_Last_30_Days": half_even(harsh * F.lit(30.0), 1),
        "Driving_Event_Score": driving_event_score(harsh, speeding_flag),
        "Aggressive_Driving_Score": aggressive_score(harsh, speeding_flag, acceleration),
        "Fatigue_Risk_Score": fatigue_score(df, night),
    })
    df = df.withColumn("Speeding_Ratio_x_Night_Driving_Ratio",
                       speeding_night_interaction(F.col("Speeding_Excess_kmh"), limit, night))
    if history is not None:
        windows = vehicle_windows(history)
        real = [c for c in windows.columns if c != "Plate"]
        windows = windows.select(F.col("Plate").alias("__plate"), *[F.col(c).alias(f"__{c}") for c in real])
        df = df.join(windows, df["Plate"] == F.col("__plate"), "left").withColumns(
            {c: F.coalesce(f"__{c}", c) for c in real}).drop("__plate", *[f"__{c}" for c in real])
    return fill_snapshot(df, as_of, order_by, plates_known)


FEATURE_FALLBACKS = (
    "Speeding_Flag", "Harsh_Events_Per_Day", "Aggressive_Driving_Score", "Recent_Avg_Speed",
    "Recent_Night_Distance", "Night_Driving_Flag",
) + risk.ENVIRONMENT_SCORES


def risk_features(df: DataFrame, filled: Presence | None = None) -> DataFrame:
    """Complete the columns that the risk components read."""
    own = filled is None
    if own:
        filled = Presence(df, FEATURE_FALLBACKS)
        df = filled.attach(df)

    def kept_or(name: str, fallback: Column) -> Column:
        """The column (NULL as zero) when any row holds it, else the fallback."""
        if not filled.asked(name):
            return fallback
        return F.when(filled(name), num(df, name, 0.0)).otherwise(fallback)

    speed = num(df, "Speed_kmh", 0.0)
    limit = num(df, "Base_Road_Max_Speed_kmh")
    harsh = num(df, "Recent_Harsh_Events", 0.0)
    ratio = F.coalesce(num(df, "Speed_to_Road_Limit_Ratio"), F.try_divide(speed, limit), F.lit(0.0))
    infinite = F.abs(ratio) == F.lit(float("inf"))
    parts = ("Harsh_Corner_Count", "Harsh_Accel_Count", "Harsh_Brake_Count")
    if all(has(df, c) for c in parts):
        per_day = sum((_whole(num(df, c, 0.0)) for c in parts[1:]), _whole(num(df, parts[0], 0.0)))
    else:
        per_day = _whole(F.rint(kept_or("Harsh_Events_Per_Day",
                                        harsh / risk.trip_hours(df) * F.lit(24.0))))
    night_raw = _whole(num(df, "Night_Driving_Flag", 0.0))
    night_bucket = (cal.night_flag(text(df, "Time_of_Day")) if has(df, "Time_of_Day") else F.lit(0))
    out = {
        "Speed_to_Road_Limit_Ratio": F.when(infinite, F.lit(0.0)).otherwise(bound(ratio, low=0.0)),
        "Speeding_Excess_kmh": F.coalesce(num(df, "Speeding_Excess_kmh"), clip(speed - limit, low=0.0), F.lit(0.0)),
        "Speeding_Flag": _whole(kept_or(
            "Speeding_Flag", F.coalesce(speed > limit, F.lit(False)).cast("double"))),
        "Harsh_Events_Per_Day": per_day,
        "Recent_Avg_Speed": kept_or("Recent_Avg_Speed", bound(speed * F.lit(0.95), 0.0, 180.0)),
        "Recent_Night_Distance": kept_or(
            "Recent_Night_Distance",
            speed * F.when(night_raw == 1, F.lit(0.45)).otherwise(F.lit(0.08))),
        "Night_Driving_Flag": _whole(kept_or("Night_Driving_Flag", night_bucket.cast("double"))),
        "Road_Type_Risk_Score": risk.road(df, filled),
        "Time_of_Day_Risk_Score": risk.time_bucket(df, filled),
        "Day_of_Week_Risk_Score": risk.weekday(df, filled),
        "Total_Distance_Monthly_km": F.coalesce(
            num(df, "Total_Distance_Monthly_km"), num(df, "Trip_Distance_km", 0.0) * F.lit(22.0)),
    }
    staged = df.withColumns(out)
    aggressive = kept_or("Aggressive_Driving_Score", aggressive_score(
        harsh, F.col("Speeding_Flag").cast("double"), num(df, "Acceleration_mps2", 0.0)))
    staged = staged.withColumn("Aggressive_Driving_Score", aggressive)
    return staged.drop(Presence.COLUMN) if own else staged


def service_class(df: DataFrame) -> Column:
    """Public, commercial or private service."""
    kind, usage = text(df, "Type", ""), F.lower(text(df, "Usage", ""))
    return (F.when(kind.isin(*K.PUBLIC_TRANSPORT_TYPES), "public")
            .when((usage == "commercial") | kind.isin(*K.COMMERCIAL_TYPES), "commercial")
            .otherwise("private"))


def cap_harsh_totals(df: DataFrame) -> DataFrame:
    """Scale the three harsh counts down so that their sum respects the class cap."""
    kind = text(df, "Type", "")
    cap = (F.when(kind.isin(*K.PUBLIC_TRANSPORT_TYPES), 8)
           .when(kind.isin(*K.COMMERCIAL_TYPES), 6).otherwise(4))
    brake, accel, corner = (_whole(num(df, c, 0.0)) for c in
                            ("Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count"))
    staged = df.withColumns({"__cap": cap, "__total": brake + accel + corner,
                             "__brake": brake, "__accel": accel, "__corner": corner})
    over = F.col("__total") > F.col("__cap")
    scale = F.col("__cap").cast("double") / F.greatest(F.col("__total"), F.lit(1)).cast("double")
    staged = staged.withColumns({
        "Harsh_Brake_Count": F.when(over, F.floor(F.col("__brake") * scale).cast("int")).otherwise(F.col("__brake")),
        "Harsh_Accel_Count": F.when(over, F.floor(F.col("__accel") * scale).cast("int")).otherwise(F.col("__accel")),
    })
    left = F.col("__cap") - F.col("Harsh_Brake_Count") - F.col("Harsh_Accel_Count")
    staged = staged.withColumn(
        "Harsh_Corner_Count", F.when(over, F.greatest(left, F.lit(0))).otherwise(F.col("__corner")))
    return staged.drop("__cap", "__total", "__brake", "__accel", "__corner")
