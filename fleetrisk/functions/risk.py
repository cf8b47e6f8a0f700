"""Risk scalar operators (R1-R17): column expressions over one vehicle row.

Each takes the frame only to learn which columns exist; the result is a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import Presence, bin_score, bound, clip, has, lookup, num, text

# Columns whose text-based fallback applies only when the whole column is empty.
ENVIRONMENT_SCORES = (
    "Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Day_of_Week_Risk_Score", "Weather_Risk_Score",
)


def vector_bin(value: Column, bins, default: float = 0.5) -> Column:
    """Bin lookup where NULL and values under the first edge take ``default``."""
    return bin_score(value, bins, missing=default)


def scalar_bin(value: Column, bins) -> Column:
    """R2: bin lookup where NULL is neutral and an out-of-range value takes the last bin."""
    return bin_score(value, bins, missing=0.5, below=bins[-1][1])


def speeding(df: DataFrame) -> Column:
    """R3"""
    ratio = num(df, "Speed_to_Road_Limit_Ratio", 0.8)
    excess = num(df, "Speeding_Excess_kmh", 0.0)
    return (F.lit(0.6) * vector_bin(ratio, K.SPEED_RATIO_BINS, 0.0)
            + F.lit(0.4) * vector_bin(excess, K.SPEED_EXCESS_BINS, 0.0))


def trip_hours(df: DataFrame) -> Column:
    """Trip duration safe to divide by: zero counts as six minutes, NULL as one hour."""
    name = "Trip_Duration_Hour" if has(df, "Trip_Duration_Hour") else "Trip_Duration_Hours"
    hours = num(df, name, 1.0)
    return F.when(hours == 0, F.lit(0.1)).otherwise(hours)


def harsh_per_hour(df: DataFrame) -> Column:
    if has(df, "Harsh_Events_Per_Hour"):
        return num(df, "Harsh_Events_Per_Hour", 1.0)
    hours = num(df, "Trip_Duration_Hour", 1.0)
    hours = F.when(hours == 0, F.lit(0.1)).otherwise(hours)
    return num(df, "Recent_Harsh_Events", 0.0) / hours


def harsh_events(df: DataFrame, per_hour: Column | None = None) -> Column:
    """R4; ``per_hour`` may name a staged column so that the division is written once."""
    per_hour = harsh_per_hour(df) if per_hour is None else per_hour
    per_km = num(df, "Harsh_Events_Per_Km", 0.1)
    count = num(df, "Recent_Harsh_Events", 0.0)
    return (F.lit(0.4) * vector_bin(per_hour, K.HARSH_PER_HOUR_BINS, 0.0)
            + F.lit(0.3) * vector_bin(per_km, K.HARSH_PER_KM_BINS, 0.0)
            + F.lit(0.3) * vector_bin(count, K.HARSH_COUNT_BINS, 0.0))


def engine_stress(df: DataFrame) -> Column:
    return (num(df, "Engine_Load_pct", 40.0) / F.lit(100.0)
            * (num(df, "RPM", 2500.0) / F.lit(7000.0)) * F.lit(100.0))


def engine(df: DataFrame, stress: Column | None = None) -> Column:
    """R5"""
    stress = engine_stress(df) if stress is None else stress
    return (F.lit(0.5) * vector_bin(num(df, "Coolant_Temp_C", 95.0), K.COOLANT_BINS, 0.0)
            + F.lit(0.25) * vector_bin(num(df, "Battery_V", 12.5), K.BATTERY_BINS, 0.0)
            + F.lit(0.25) * vector_bin(stress, K.ENGINE_STRESS_BINS, 0.0))


def _score_or_map(df, score, label, absent, table, default, filled: Presence) -> Column:
    mapped = lookup(table, text(df, label) if has(df, label) else F.lit(absent), default)
    if not filled.asked(score):
        return mapped
    return F.when(filled(score), clip(num(df, score), 0.0, 1.0)).otherwise(mapped)


def road(df: DataFrame, filled: Presence) -> Column:
    """Existing score, else by road type."""
    return _score_or_map(df, "Road_Type_Risk_Score", "Road_Type", "Unknown", K.ROAD_RISK, 0.40, filled)


def time_bucket(df: DataFrame, filled: Presence) -> Column:
    """Existing score, else by time of day."""
    return _score_or_map(df, "Time_of_Day_Risk_Score", "Time_of_Day", "Mid-Day", K.TIME_RISK, 0.30, filled)


def weekday(df: DataFrame, filled: Presence) -> Column:
    """Existing score, else by day of week."""
    return _score_or_map(df, "Day_of_Week_Risk_Score", "Day_of_Week", "Monday", K.DAY_RISK, 0.30, filled)


def weather(df: DataFrame, filled: Presence) -> Column:
    """Existing score (factor-scale values are brought down to 0..1), else by condition."""
    label = text(df, "Weather") if has(df, "Weather") else F.lit("Sunny")
    mapped = lookup(K.WEATHER_RISK, label, 0.30)
    if not filled.asked("Weather_Risk_Score"):
        return mapped
    score = num(df, "Weather_Risk_Score")
    rescaled = F.when(score.between(0.0, 1.0), score).otherwise(score / F.lit(K.WEATHER_FACTOR_CEILING))
    return F.when(filled("Weather_Risk_Score"), clip(rescaled, 0.0, 1.0)).otherwise(mapped)


def fatigue(df: DataFrame) -> Column:
    """R8"""
    return bound(num(df, "Fatigue_Risk_Score", 0.0), 0.0, 1.0)


def city(df: DataFrame) -> Column:
    """R9"""
    return lookup(K.CITY_RISK, text(df, "City"), 0.15)


def exposure(df: DataFrame) -> Column:
    """R10"""
    return bound(num(df, "Trip_Distance_km", 0.0) / F.lit(100.0), high=1.0)


def environment(road_score: Column, time_score: Column) -> Column:
    """R11"""
    return F.lit(0.5) * road_score + F.lit(0.5) * time_score


def environmental(weather_score: Column, road_score: Column, time_score: Column,
                  day_score: Column, city_score: Column) -> Column:
    """R12"""
    return clip(F.lit(0.20) * weather_score + F.lit(0.30) * road_score + F.lit(0.20) * time_score
                + F.lit(0.10) * day_score + F.lit(0.20) * city_score, 0.0, 1.0)


def vehicle_condition(df: DataFrame) -> Column:
    """R13"""
    age = bound(num(df, "Vehicle_Age_Years", 5.0) / F.lit(20.0), high=1.0)
    efficiency = bound((num(df, "Fuel_Efficiency_L_per_100km", 8.5) - F.lit(5.0)) / F.lit(10.0), low=0.0)
    return age * F.lit(0.5) + efficiency * F.lit(0.3)


def behavioural(df: DataFrame) -> Column:
    """R14"""
    def pick(flag: str, on: float, off: float) -> Column:
        return F.when(num(df, flag, 0.0) != 0, F.lit(on)).otherwise(F.lit(off))

    return (F.lit(0.4) * pick("Night_Driving_Flag", 0.6, 0.2)
            + F.lit(0.3) * pick("Is_Weekend", 0.35, 0.25)
            + F.lit(0.3) * pick("Evening_Peak_Flag", 0.5, 0.3))


def overall(speeding_risk: Column, harsh_risk: Column, fatigue_risk: Column, weather_risk: Column,
            exposure_risk: Column, environment_risk: Column) -> Column:
    """R15"""
    return clip(F.lit(0.30) * speeding_risk + F.lit(0.25) * harsh_risk + F.lit(0.15) * fatigue_risk
                + F.lit(0.10) * weather_risk + F.lit(0.10) * exposure_risk
                + F.lit(0.10) * environment_risk, 0.0, 1.0)


def smooth(score: Column, prior: Column, max_delta: float = 0.02) -> Column:
    """Move at most ``max_delta`` from the prior score; no prior takes the new score."""
    step = bound(score - prior, -max_delta, max_delta)
    return F.when(prior.isNull(), score).when(score.isNotNull(), bound(prior + step, 0.0, 1.0))


def band(score: Column) -> Column:
    """Risk band; a missing score is neutral."""
    return (
        F.when(score >= K.BAND_CRITICAL_MIN, "Critical")
        .when(score >= K.BAND_HIGH_MIN, "High")
        .when((score >= K.BAND_MEDIUM_MIN) | score.isNull(), "Medium")
        .otherwise("Low")
    )


def slot_jitter(plate: Column, score: Column, slot: int | Column, day: Column, step: float = 0.005) -> Column:
    """Repeatable slot jitter of the score.

    A plate moves by -1, 0 or +1 step per time slot, only when its direction equals
    that of the slot before; one plate in twelve stands still for the whole day.
    """
    slot = slot if isinstance(slot, Column) else F.lit(int(slot)).cast("long")

    def direction(at: Column) -> Column:
        return F.pmod(F.xxhash64(plate, at), F.lit(3)) - F.lit(1)

    stable = F.pmod(F.xxhash64(plate, day), F.lit(12)) == 0
    moves = ~stable & (F.trim(plate) != "") & (direction(slot) == direction(slot - F.lit(1)))
    shift = F.when(moves, direction(slot).cast("double") * F.lit(step)).otherwise(F.lit(0.0))
    return clip(score + shift, 0.0, 1.0)
