"""Whole-row scoring: canonical score, live outputs, model-free score."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import risk
from fleetrisk.functions.columns import Presence, bound, first_num, has, lookup, num, text
from fleetrisk.operators.features import FEATURE_FALLBACKS, risk_features

SCORE_CANDIDATES = ("Calculated_Risk_Score", "Risk_Score", "LightGBM_Risk_Score", "Custom_Risk_Score")


def canonical_scores(df: DataFrame, source: str | None = None, filled: Presence | None = None) -> DataFrame:
    """One canonical score, taken from the first candidate column that holds any value."""
    order = list(dict.fromkeys(([source] if source else []) + list(SCORE_CANDIDATES)))
    order = [c for c in order if has(df, c)]
    filled = filled or Presence(df, order)
    df = filled.attach(df)
    pick = None
    for name in order:
        pick = (F.when(filled(name), num(df, name)) if pick is None
                else pick.when(filled(name), num(df, name)))
    score = bound(F.coalesce(pick, F.lit(0.5)) if pick is not None else F.lit(0.5), 0.0, 1.0)
    df = df.withColumns({
        "LightGBM_Risk_Score": num(df, "LightGBM_Risk_Score"),
        "Calculated_Risk_Score": score,
    }).drop(Presence.COLUMN)
    score = F.col("Calculated_Risk_Score")
    band = risk.band(score)
    return df.withColumns({
        "Risk_Score": score,
        "LightGBM_Risk_Score": bound(F.coalesce(F.col("LightGBM_Risk_Score"), score), 0.0, 1.0),
        "Risk_Band": band,
        "Calculated_Risk_Band": band,
    })


def risk_components(df: DataFrame, filled: Presence) -> DataFrame:
    """R3-R15 side by side; the inputs must already carry the completed risk features."""
    df = df.withColumns({
        "__per_hour": risk.harsh_per_hour(df), "__stress": risk.engine_stress(df),
        "__weather": risk.weather(df, filled), "__fatigue": risk.fatigue(df),
        "__exposure": risk.exposure(df), "City_Risk_Score": risk.city(df),
    })
    road, clock, day = (F.col(c) for c in
                        ("Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Day_of_Week_Risk_Score"))
    df = df.withColumns({
        "Speeding_Risk": risk.speeding(df),
        "Harsh_Risk": risk.harsh_events(df, F.col("__per_hour")),
        "Engine_Risk": risk.engine(df, F.col("__stress")),
        "Environmental_Risk": risk.environmental(F.col("__weather"), road, clock, day, F.col("City_Risk_Score")),
        "Vehicle_Condition_Risk": risk.vehicle_condition(df),
        "Behavioral_Risk": risk.behavioural(df),
    })
    fresh = risk.overall(F.col("Speeding_Risk"), F.col("Harsh_Risk"), F.col("__fatigue"), F.col("__weather"),
                         F.col("__exposure"), risk.environment(road, clock))
    return df.withColumn("__fresh", fresh).drop("__per_hour", "__stress", "__weather", "__fatigue", "__exposure")


def live_risk_outputs(df: DataFrame, filled: Presence | None = None) -> DataFrame:
    """Features, components, smoothed score with class surcharges, band, claim, action."""
    filled = filled or Presence(df, FEATURE_FALLBACKS)
    df = filled.attach(df)
    smoothed = has(df, "Calculated_Risk_Score") or has(df, "Risk_Score")
    if smoothed:
        df = df.withColumn("__prior", first_num(df, ("Calculated_Risk_Score", "Risk_Score")))
    df = risk_components(risk_features(df, filled), filled)
    score = risk.smooth(F.col("__fresh"), F.col("__prior")) if smoothed else F.col("__fresh")

    public = text(df, "Type", "").isin(*K.PUBLIC_TRANSPORT_TYPES)
    commercial = ((F.lower(text(df, "Usage", "")) == "commercial")
                  | text(df, "Type", "").isin(*K.COMMERCIAL_TYPES))
    older = public & (num(df, "Vehicle_Age_Years", 0.0) >= 12)
    # The surcharges only add, so one cap at the end equals a cap after each of them.
    for mask, extra in ((commercial, 0.015), (public, 0.025), (older, 0.010)):
        score = score + F.when(mask, F.lit(extra)).otherwise(F.lit(0.0))
    df = df.withColumns({
        "Calculated_Risk_Score": bound(F.coalesce(score, F.lit(0.5)), 0.0, 1.0),
        "LightGBM_Risk_Score": num(df, "LightGBM_Risk_Score"),
    }).drop("__prior", "__fresh", Presence.COLUMN)
    score = F.col("Calculated_Risk_Score")
    band = risk.band(score)
    df = df.withColumns({
        "Risk_Score": score, "Risk_Band": band, "Calculated_Risk_Band": band,
        "LightGBM_Risk_Score": bound(F.coalesce(F.col("LightGBM_Risk_Score"), score), 0.0, 1.0),
    })
    claim = F.coalesce(num(df, "Expected_Claim_USD"), num(df, "Expected_Claim"),
                       lookup(K.BAND_EXPECTED_CLAIM, F.col("Risk_Band"), 2200.0))
    out = {
        "Custom_Risk_Score": (score + F.col("LightGBM_Risk_Score")) / F.lit(2.0),
        "Expected_Claim": claim, "Expected_Claim_USD": claim,
        "Risk_Action": lookup(K.BAND_REVIEW_ACTION, F.col("Risk_Band"), "Monitor"),
    }
    if not has(df, "Risk_Label"):
        out["Risk_Label"] = F.col("Risk_Band")
    return df.withColumns(out)


def jittered_scores(df: DataFrame, as_of: datetime, slot_seconds: int = 900, step: float = 0.005) -> DataFrame:
    """Repeatable slot jitter of ``Risk_Score`` at the slot of ``as_of``."""
    if not has(df, "Risk_Score"):
        return df
    slot = int((as_of - datetime(1970, 1, 1)).total_seconds() // slot_seconds)
    score = risk.slot_jitter(text(df, "Plate", ""), num(df, "Risk_Score"), slot,
                             F.lit(as_of.date().isoformat()), step)
    return df.withColumn("Risk_Score", score)


def explainable_scores(df: DataFrame, filled: Presence | None = None) -> DataFrame:
    """Model-free weighted score; it fills the shared score columns that hold nothing."""
    filled = filled or Presence(df, ("Risk_Score", "Calculated_Risk_Score"))
    df = filled.attach(df)
    harsh = bound(num(df, "Recent_Harsh_Events", 0.0) / F.lit(5.0), 0.0, 1.0)
    limit = num(df, "Base_Road_Max_Speed_kmh", 85.0)
    speeding = bound(num(df, "Speeding_Excess_kmh", 0.0) / (limit + F.lit(1e-6)), 0.0, 1.0)
    battery = bound(F.lit(1.0) - num(df, "Battery_Health_Score", 55.0) / F.lit(100.0), 0.0, 1.0)
    score = bound(
        F.lit(0.25) * harsh + F.lit(0.20) * num(df, "Aggressive_Driving_Score", 0.0)
        + F.lit(0.20) * speeding + F.lit(0.15) * battery
        + F.lit(0.15) * num(df, "Coolant_Overheat_Flag", 0.0).cast("int")
        + F.lit(0.10) * num(df, "Night_Driving_Flag", 0.0).cast("int"), 0.0, 1.0)
    df = df.withColumn("LightGBM_Risk_Score", score)
    model = F.col("LightGBM_Risk_Score")
    cols = {}
    for name in ("Risk_Score", "Calculated_Risk_Score"):
        cols[name] = (F.when(filled(name), num(df, name)).otherwise(model)
                      if filled.asked(name) else model)
    df = df.withColumns(cols).drop(Presence.COLUMN)
    if not has(df, "Risk_Band"):
        # A missing kept score fails every threshold here, so it bands as Low.
        df = df.withColumn("Risk_Band", F.when(F.col("Risk_Score").isNull(), F.lit("Low"))
                           .otherwise(risk.band(F.col("Risk_Score"))))
    return df


def ensure_model_scores(
    df: DataFrame,
    cached: DataFrame | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Reuse scores that exist, else look them up by plate, else model, else P1.

    ``cached`` holds recent scores (Plate, LightGBM_Risk_Score); ``model`` maps a frame to
    the same frame with ``LightGBM_Risk_Score``. A cache that knows none of the plates is no
    cache: a job that stops at the first match finds out while the plan is built.
    """
    if has(df, "Calculated_Risk_Score") and has(df, "LightGBM_Risk_Score"):
        return df
    if cached is not None and "LightGBM_Risk_Score" in cached.schema.names and has(df, "Plate"):
        known = cached.filter(F.col("LightGBM_Risk_Score").isNotNull()).select("Plate")
        if df.select("Plate").join(known, "Plate", "left_semi").isEmpty():
            cached = None
    else:
        cached = None
    if cached is not None:
        from fleetrisk.operators.joins import score_lookup

        scored = score_lookup(df, cached)
    elif model is not None:
        scored = model(df)
    else:
        return explainable_scores(df)
    names = ("Risk_Score", "Calculated_Risk_Score")
    filled = Presence(scored, names)
    scored = filled.attach(scored)
    scored = scored.withColumns({
        name: F.when(filled(name), num(scored, name)).otherwise(F.col("LightGBM_Risk_Score")) for name in names
    }).drop(Presence.COLUMN)
    if not has(scored, "Risk_Band"):
        scored = scored.withColumn("Risk_Band", F.when(F.col("Risk_Score").isNull(), F.lit("Low"))
                                   .otherwise(risk.band(F.col("Risk_Score"))))
    return scored

