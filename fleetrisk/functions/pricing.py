"""Policy, premium and currency expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions.columns import bound, clip, half_even, lookup, num, text


def base_annual(vehicle_type: Column) -> Column:
    return lookup(K.BASE_PREMIUM, vehicle_type, K.BASE_PREMIUM_DEFAULT)


def list_price(vehicle_type: Column) -> Column:
    """Annual list price of a vehicle type; unknown types take the high default."""
    return lookup(K.BASE_PREMIUM, vehicle_type, K.BASE_PREMIUM_LIST_PRICE_DEFAULT)


def risk_loading(score: Column) -> Column:
    return F.lit(0.62) + score * F.lit(1.33)


def daily_premium(score: Column, vehicle_type: Column) -> Column:
    """P5"""
    return clip(base_annual(vehicle_type) * risk_loading(score) / F.lit(12.0) / F.lit(30.0), 1.0, 13.33)


def monthly_premium(score: Column, vehicle_type: Column) -> Column:
    """P6"""
    return clip(base_annual(vehicle_type) * risk_loading(score) / F.lit(12.0), 30.0, 400.0)


def band_multiplier(band: Column) -> Column:
    """P7"""
    return lookup(K.BAND_MULTIPLIER, band, 1.0)


def claim_probability(score: Column) -> Column:
    """P8"""
    return F.lit(0.01) + score * F.lit(0.44)


def expected_monthly_claim(price: Column, score: Column) -> Column:
    return price * claim_probability(score) * F.lit(K.CLAIM_SEVERITY_RATIO) / F.lit(12.0)


def policy_action(band: Column) -> Column:
    """A missing band counts as Medium, an unknown one as a standard offer."""
    return lookup(K.BAND_POLICY_ACTION, F.coalesce(band, F.lit("Medium")), "standard_offer")


def policy_multiplier(action: Column) -> Column:
    """P4"""
    return lookup(K.POLICY_MULTIPLIER, action, 1.0)


def to_zig(usd: Column, rate: float) -> Column:
    """Converted amount at 2 decimals, NULL as zero."""
    return half_even(F.coalesce(usd, F.lit(0.0)) * F.lit(float(rate)), 2)


def behaviour_claim(df: DataFrame) -> Column:
    """Multiplicative claim estimate from driving behaviour."""
    harsh = bound(num(df, "Recent_Harsh_Events", 0.0), high=10.0)
    amount = (
        F.lit(2500.0)
        * (F.lit(1.0) + num(df, "Aggressive_Driving_Score", 0.0) * F.lit(0.8))
        * (F.lit(1.0) + num(df, "Speeding_Ratio_x_Night_Driving_Ratio", 0.0) * F.lit(1.2))
        * num(df, "Weather_Risk_Score", 1.0)
        * (F.lit(1.0) + num(df, "Fatigue_Risk_Score", 0.0) * F.lit(0.6))
        * (F.lit(1.0) + harsh / F.lit(10.0) * F.lit(0.5))
    )
    return bound(amount, 800.0, 15000.0)


def minimum_action(score: Column) -> Column:
    """Least severe action code allowed at a score (its own thresholds, not the bands)."""
    score = F.coalesce(score, F.lit(0.0))
    return (F.when(score >= 0.82, 3).when(score >= 0.66, 2).when(score >= 0.45, 1).otherwise(0)).cast("int")


def driver_advice(df: DataFrame) -> Column:
    """Ordered, distinct advice texts for a vehicle, as an array."""
    def say(key: str) -> Column:
        return F.lit(K.ADVICE[key])

    band = F.trim(text(df, "Risk_Band", ""))
    status = F.trim(text(df, "Status", ""))
    usage = F.lower(F.trim(text(df, "Usage", "")))
    level = F.lower(F.trim(text(df, "Fraud_Risk_Level", "")))
    harsh = num(df, "Recent_Harsh_Events", 0.0)
    fuel = num(df, "Fuel_Efficiency_L_per_100km", 0.0)
    premium = num(df, "Monthly_Premium_USD", 0.0)
    profit = num(df, "Underwriting_Profit_USD", 0.0)
    rules = [
        F.when(band.isin("High", "Critical"), say("band_high"))
        .when(band == "Medium", say("band_medium")).otherwise(say("band_low")),
        F.when((num(df, "Speed_kmh", 0.0) > 110) | (num(df, "Speeding_Flag", 0.0) == 1), say("speeding")),
        F.when(harsh >= 3, say("harsh_many")).when(harsh >= 1, say("harsh_some")),
        F.when(fuel > 12, say("fuel_high")).when(fuel < 5, say("fuel_low")),
        F.when((premium >= 75) | (num(df, "Monthly_Premium_ZIG", 0.0) >= 1000), say("premium_high"))
        .when(premium > 40, say("premium_mid")).otherwise(say("premium_low")),
        F.when(num(df, "Expected_Claim_USD", 0.0) > 1500, say("claim_high")),
        F.when(profit < 0, say("profit_negative")).when(premium > 0, say("profit_ok")),
        F.when((num(df, "Fraud_Risk_Score", 0.0) >= 0.5) | level.isin("high", "critical"), say("fraud")),
        F.when(status == "Driving", say("driving")).when(status == "Parked", say("parked")),
        F.when(usage == "commercial", say("commercial")),
    ]
    return F.array_distinct(F.array_compact(F.array(*rules)))
