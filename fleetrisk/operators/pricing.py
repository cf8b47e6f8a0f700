"""Quotes, profitability, currency columns and the premium schedule."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import pricing as px
from fleetrisk.functions import risk
from fleetrisk.functions.columns import bound, first_num, half_even, has, lookup, num, round_columns, text
from fleetrisk.operators.cleaning import select_existing
from fleetrisk.operators.joins import overlay
from fleetrisk.operators.scoring import canonical_scores, ensure_model_scores, jittered_scores


def apply_policy(df: DataFrame) -> DataFrame:
    """P3 + P4: policy action from the band, premium multiplier from the action."""
    band = text(df, "Risk_Band") if has(df, "Risk_Band") else risk.band(num(df, "Calculated_Risk_Score", 0.5))
    df = df.withColumn("PPO_Action", px.policy_action(band))
    return df.withColumn("Premium_Multiplier", px.policy_multiplier(F.col("PPO_Action")))


def live_policy(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Canonical scores with their policy fields; jitter (R20) only when ``as_of`` is given."""
    df = canonical_scores(df)
    if as_of is not None:
        df = canonical_scores(jittered_scores(df, as_of), "Risk_Score")
    return apply_policy(df)


def quote(df: DataFrame, as_of: datetime, **model) -> DataFrame:
    """Scored, policy-adjusted premium quote."""
    df = apply_policy(ensure_model_scores(df, **model))
    df = df.withColumn("__score", bound(first_num(df, ("Calculated_Risk_Score", "Risk_Score"), 0.5), 0.0, 1.0))
    monthly = px.monthly_premium(F.col("__score"), text(df, "Type", "Sedan"))
    df = df.withColumn("__monthly", monthly)
    daily = bound(F.col("__monthly") / F.lit(30.0), 1.0, 13.33)
    claim = px.expected_monthly_claim(num(df, "Base_Price_USD", 6000.0), F.col("__score"))
    factor = F.col("Premium_Multiplier")
    df = df.withColumns({
        "Risk_Based_Daily_Premium_USD": half_even(daily, 2),
        "Risk_Based_Monthly_Premium_USD": half_even(F.col("__monthly"), 2),
        "Policy_Adjusted_Daily_Premium_USD": half_even(daily * factor, 2),
        "Policy_Adjusted_Monthly_Premium_USD": half_even(F.col("__monthly") * factor, 2),
        "Expected_Claim_USD": half_even(claim, 2),
        "Decision_Status": F.when(F.col("PPO_Action") == "decline", "declined").otherwise("quoted"),
        "Decision_Timestamp": F.lit(as_of.isoformat()),
    })
    return df.drop("__score", "__monthly")


def add_zig_columns(df: DataFrame, rate: float = K.USD_TO_ZIG_RATE, only_missing: bool = False) -> DataFrame:
    """Every ``*_USD`` column gains its ``*_ZIG`` twin."""
    cols: dict[str, Column] = {}
    for name in df.schema.names:
        if name.endswith("_USD"):
            twin = name.replace("_USD", "_ZIG")
            if not (only_missing and has(df, twin)):
                cols[twin] = px.to_zig(num(df, name), rate)
    return df.withColumns(cols) if cols else df


def profitability(df: DataFrame, rate: float = K.USD_TO_ZIG_RATE, **model) -> DataFrame:
    """P10: premiums, claims, expenses, floored profit and currency twins per vehicle."""
    df = ensure_model_scores(df, **model)
    score = first_num(df, ("Calculated_Risk_Score", "LightGBM_Risk_Score"), 0.5)
    df = df.withColumn("Calculated_Risk_Score", score)
    score = F.col("Calculated_Risk_Score")
    band = text(df, "Risk_Band") if has(df, "Risk_Band") else risk.band(score)
    df = df.withColumns({
        "Risk_Band": band, "Base_Price_USD": num(df, "Base_Price_USD", 0.0),
        "__risk": bound(score, 0.0, 1.0), "__kind": text(df, "Type", "Sedan"),
    })
    score, band, kind = F.col("__risk"), F.col("Risk_Band"), F.col("__kind")
    probability = bound(px.claim_probability(score), 0.01, 0.45)
    claim = F.col("Base_Price_USD") * probability * F.lit(K.CLAIM_SEVERITY_RATIO) / F.lit(12.0)
    service = (F.coalesce(text(df, "Usage") == "Commercial", F.lit(False))
               | F.coalesce(text(df, "Type").isin(*K.PUBLIC_PRICING_TYPES), F.lit(False)))
    df = df.withColumns({
        "Daily_Premium_USD": num(df, "Daily_Premium_USD", px.daily_premium(score, kind)),
        "Monthly_Premium_USD": num(df, "Monthly_Premium_USD", px.monthly_premium(score, kind)),
        "Expected_Claim": claim, "Expected_Claim_USD": claim,
        "USD_to_ZIG_Interbank_Rate": F.lit(float(rate)),
        "Recommended_Action": lookup(K.ACTION_CODE, band, 0),
        "__control": lookup(K.ACTION_CONTROL_COST, band, 0.0),
        "__admin": F.when(service, F.lit(K.COMMERCIAL_ADMIN_COST)).otherwise(F.lit(K.PRIVATE_ADMIN_COST)),
        "__ratio": F.when(service, F.lit(K.COMMERCIAL_EXPENSE_RATIO)).otherwise(F.lit(K.PRIVATE_EXPENSE_RATIO))
        + lookup(K.BAND_EXPENSE_LOADING, band, 0.0),
    })
    monthly = F.col("Monthly_Premium_USD")
    df = df.withColumn("__variable", monthly * F.col("__ratio"))
    df = df.withColumn("__total", F.col("__variable") + F.col("__control") + F.col("__admin"))
    profit = bound(monthly - F.col("Expected_Claim_USD") - F.col("__total"), low=0.0)
    df = df.withColumns({
        "Variable_Expenses_USD": half_even(F.col("__variable"), 2),
        "Control_Cost_USD": half_even(F.col("__control"), 2),
        "Underwriting_Expenses_USD": half_even(F.col("__total"), 2),
        "Underwriting_Profit_USD": half_even(profit, 2),
    }).drop("__risk", "__kind", "__control", "__admin", "__ratio", "__variable", "__total")
    return add_zig_columns(df, rate)


_SCHEDULE_INPUT = (
    "Risk_Score", "Risk_Band", "Base_Price_USD", "Expected_Claim_USD", "Daily_Premium_USD",
    "Monthly_Premium_USD", "Underwriting_Expenses_USD", "Underwriting_Profit_USD",
)


def live_risk_table(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Live vehicle risk table with policy fields."""
    return select_existing(live_policy(ensure_model_scores(df), as_of), K.LIVE_RISK_COLUMNS)


def premium_schedule(df: DataFrame, rate: float = K.USD_TO_ZIG_RATE, live: DataFrame | None = None,
                     order: Sequence[str | Column] | None = None, unique_plates: bool = False) -> DataFrame:
    """The 20-column premium schedule.

    Make, model, score and band come from the last row per plate (by ``order``; without one the
    greatest) of the live risk table: ``live``, or this frame's own canonical view. With
    ``unique_plates`` that view is the frame itself, and no join is made.
    """
    if not all(has(df, c) for c in _SCHEDULE_INPUT):
        df = profitability(df, rate)
    if live is None:
        table = canonical_scores(df)
        if not unique_plates and has(table, "Plate"):
            table = overlay(table, table, ("Make", "Model", "Risk_Score", "Risk_Band"), order)
    else:
        table = overlay(df, live, ("Make", "Model", "Risk_Score", "Risk_Band"), order)
    table = add_zig_columns(table, rate)
    money = {c: 2 for c in K.SCHEDULE_COLUMNS if c.endswith(("_USD", "_ZIG"))}
    return round_columns(select_existing(table, K.SCHEDULE_COLUMNS), {**money, "Risk_Score": 2})
