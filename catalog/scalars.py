"""Row-level queries: cleaning, features, filters, risk and pricing expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import AS_OF, project, query, r
from fleetrisk import constants as K
from fleetrisk.functions import pricing as px
from fleetrisk.functions import risk
from fleetrisk.functions.columns import Presence, num
from fleetrisk.operators import cleaning, features, filters, pricing, scoring
from fleetrisk.plans.portfolio import live_table, map_quotes

# --- sources ----------------------------------------------------------------
project("I4_history_scan", "history", "event_id", ("Plate", "Last_Update", "Status", "City"), ("Speed_kmh",))


@query("I5_row_sample")
def _(v):
    return filters.sample_rows(v.portfolio.select("Plate", "City", "Base_Price_USD"), 200, seed=7)


# --- cleaning and features ----------------------------------------------------
def _messy(v):
    """The portfolio as an upload: padded names, an index column, gaps and a text price."""
    third = F.col("c_custkey") % 3 == 0
    df = v.portfolio.select(
        "c_custkey", F.when(third, F.lit(None)).otherwise(F.col("Plate")).alias("Plate"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("Type")).alias(" Type"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("abc")).otherwise(
            (F.col("Base_Price_USD") - 400).cast("string")).alias("Vehicle_Value_USD"),
        F.col("c_custkey").alias("Unnamed: 0"))
    return df


_MESSY = """SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE Plate END AS p,
  CASE WHEN c_custkey % 5 = 0 THEN 'Sedan' ELSE Type END AS Type,
  CASE WHEN c_custkey % 7 = 0 THEN 6000e0 ELSE greatest(Base_Price_USD - 400, 500e0) END AS price
FROM portfolio"""
_PLATE = """CASE WHEN p IS NULL THEN 'A' || chr(CAST(65 + (n // 9000) % 676 // 26 AS INT))
  || chr(CAST(65 + (n // 9000) % 676 % 26 AS INT)) || lpad(CAST(n % 9000 + 1000 AS VARCHAR), 4, '0') ELSE p END"""


@query("C1_portfolio_clean", f"""SELECT c_custkey, {_PLATE} AS Plate, Type, 'Private' AS Usage, 'Driving' AS Status,
  'Harare' AS City, {r('price', 'Base_Price_USD')} FROM (SELECT m.*, row_number() OVER
  (PARTITION BY p IS NULL ORDER BY c_custkey) - 1 AS n FROM ({_MESSY}) m)""")
def _(v):
    df = cleaning.clean_portfolio(_messy(v), order_by="c_custkey")
    return df.select("c_custkey", "Plate", "Type", "Usage", "Status", "City", "Base_Price_USD")


@query("C2_placeholder_plates", f"""SELECT c_custkey, {_PLATE} AS Plate FROM (SELECT m.*, row_number() OVER
  (PARTITION BY p IS NULL ORDER BY c_custkey) - 1 AS n FROM ({_MESSY}) m)""")
def _(v):
    return cleaning.fill_plates(_messy(v).select("c_custkey", "Plate"), order_by="c_custkey")


@query("C3_snapshot_defaults", f"""SELECT Plate, Trip_ID, Class, Status, Road_Type, Weather, Year, Engine_CC,
  Total_Harsh_Events_per_Day, {r('RPM')}, {r('Battery_V')}, {r('Fuel_Efficiency_L_per_100km')}, Last_Update,
  Time_of_Day, Day_of_Week, DATE '2023-10-04' AS Policy_Start_Date, DATE '2024-10-03' AS Expiry_Date FROM prepared""")
def _(v):
    return features.fill_snapshot(v.portfolio, AS_OF, plates_known=True).select(
        "Plate", "Trip_ID", "Class", "Status", "Road_Type", "Weather", "Year", "Engine_CC",
        "Total_Harsh_Events_per_Day", "RPM", "Battery_V", "Fuel_Efficiency_L_per_100km", "Last_Update",
        "Time_of_Day", "Day_of_Week", "Policy_Start_Date", "Expiry_Date")


@query("C4_safe_numeric", """SELECT c_custkey, coalesce(TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'abc'
  ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE), -1e0) AS value FROM portfolio""")
def _(v):
    df = v.portfolio.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "abc").otherwise(
        F.col("c_custkey").cast("string")).alias("t"))
    return df.select("c_custkey", num(df, "t", -1.0).alias("value"))


project("C5_time_of_day", "history", "event_id", ("Time_of_Day",))
project("C6_day_name", "history", "event_id", ("Day_of_Week",))
project("C7_night_flag", "h_prepared", "event_id", ("Night_Driving_Flag",))
project("C8_vehicle_age", "prepared", "Plate", (), ("Vehicle_Age_Years",))
project("C9_road_one_hot", "h_prepared", "event_id", (), ("Potholed_Ratio", "Gravel_Ratio", "Highway_Ratio", "Urban_Ratio"))
project("C10_road_limit", "h_prepared", "event_id", (), ("Base_Road_Max_Speed_kmh",))
project("C11_speeding_excess", "h_prepared", "event_id", (), ("Speeding_Excess_kmh",))
project("C12_recent_harsh_speed", "h_prepared", "event_id", (), ("Recent_Harsh_Events", "Recent_Avg_Speed"))
project("C13_speeding_ratio", "h_prepared", "event_id", (), ("Recent_Speeding_Ratio",))
project("C14_night_distance", "h_prepared", "event_id", (), ("Recent_Night_Distance",))
project("C15_window_proxies", "h_prepared", "event_id", (), ("Avg_Speed_Last_7_Days", "Total_Harsh_Events_Last_30_Days"))
project("C16_speeding_night", "h_prepared", "event_id", (), ("Speeding_Ratio_x_Night_Driving_Ratio",))
project("C17_battery_health", "h_prepared", "event_id", (), ("Battery_Health_Score",))
project("C18_weather_factor", "h_prepared", "event_id", (), ("Weather_Risk_Score",))
project("C19_driving_event", "h_prepared", "event_id", (), ("Driving_Event_Score",))
project("C20_aggressive", "h_prepared", "event_id", (), ("Aggressive_Driving_Score",))
project("C21_fatigue", "h_prepared", "event_id", (), ("Fatigue_Risk_Score",))
project("C22_coolant_overheat", "h_prepared", "event_id", ("Coolant_Overheat_Flag",))
project("C23_stamp_parts", "h_prepared", "event_id",
        ("Update_Year", "Update_Month", "Update_Day", "Update_Hour", "Update_Minute"),
        names={c: f"CAST({c} AS INT)" for c in ("Update_Year", "Update_Month", "Update_Day", "Update_Hour", "Update_Minute")})
project("C24_preprocess", "prepared", "Plate", ("Night_Driving_Flag", "City", "Type", "Weather", "Road_Type"), (
    "Vehicle_Age_Years", "Base_Road_Max_Speed_kmh", "Recent_Harsh_Events", "Battery_Health_Score",
    "Weather_Risk_Score", "Aggressive_Driving_Score", "Fatigue_Risk_Score", "Speeding_Excess_kmh"))
project("C25_risk_features", "h_live", "event_id", ("Harsh_Events_Per_Day",), (
    "Speed_to_Road_Limit_Ratio", "Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Day_of_Week_Risk_Score",
    "Total_Distance_Monthly_km"))

_RAW = f"""SELECT event_id,
  CASE WHEN Time_of_Day IN ('Night', 'Late Night', 'Dawn') THEN 1 ELSE 0 END AS Night_Driving_Flag,
  {r(S.clip("0.35e0 * 0e0 + 0.35e0 * Speeding_Flag + 0.30e0 * least(abs(Acceleration_mps2) / 6e0, 1e0)", 0.0, 1.0),
     'Aggressive_Driving_Score', 6)},
  {r(S.clip('Speed_kmh * 0.95e0', 0.0, 180.0), 'Recent_Avg_Speed', 6)},
  {r('Speed_kmh * 0.08e0', 'Recent_Night_Distance', 6)},
  {r(S.case_map('Road_Type', K.ROAD_RISK, 0.40), 'Road_Type_Risk_Score', 6)} FROM history"""


@query("C25_risk_features_raw", _RAW, 6)
def _(v):
    return features.risk_features(v.history).select(
        "event_id", "Night_Driving_Flag", "Aggressive_Driving_Score", "Recent_Avg_Speed", "Recent_Night_Distance",
        "Road_Type_Risk_Score")


@query("C26_harsh_cap", """SELECT event_id,
  CAST(CASE WHEN t > cap THEN floor(b * (cap * 1e0 / greatest(t, 1))) ELSE b END AS INT) AS Harsh_Brake_Count,
  CAST(CASE WHEN t > cap THEN floor(a * (cap * 1e0 / greatest(t, 1))) ELSE a END AS INT) AS Harsh_Accel_Count,
  CAST(CASE WHEN t > cap THEN greatest(cap - floor(b * (cap * 1e0 / greatest(t, 1)))
    - floor(a * (cap * 1e0 / greatest(t, 1))), 0) ELSE c END AS INT) AS Harsh_Corner_Count
  FROM (SELECT event_id, Harsh_Brake_Count AS b, Harsh_Accel_Count AS a, Harsh_Corner_Count AS c,
  Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count AS t, 4 AS cap FROM history)""")
def _(v):
    return features.cap_harsh_totals(v.history).select(
        "event_id", "Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count")


@query("C27_service_class", """SELECT Plate, CASE WHEN Type IN ('Kombi', 'Minibus', 'Bus') THEN 'public'
  WHEN lower(Usage) = 'commercial' OR Type IN ('Pickup', 'Van', 'Light Truck', 'Heavy Truck') THEN 'commercial'
  ELSE 'private' END AS service FROM portfolio""")
def _(v):
    return v.portfolio.select("Plate", features.service_class(v.portfolio).alias("service"))


@query("C29_live_risk_table", f"""SELECT Plate, Type, City, Make, Model, {r('Risk_Score')}, Risk_Band, PPO_Action,
  {r('Premium_Multiplier')}, {r('Speed_kmh')}, {r('Speeding_Excess_kmh')}, {r('Acceleration_mps2')},
  Harsh_Events_Per_Day, {r('Aggressive_Driving_Score')}, {r('Weather_Risk_Score')}, {r('Road_Type_Risk_Score')},
  {r('Time_of_Day_Risk_Score')}, Night_Driving_Flag, {r('Fatigue_Risk_Score')}, {r('Recent_Avg_Speed')},
  {r('Recent_Harsh_Events')}, {r('Recent_Night_Distance')}, Engine_CC, Year FROM priced""")
def _(v):
    return live_table(v.live)


@query("C29_overview_table", f"""SELECT Plate, Type, City, {r('City_Risk_Score')}, Risk_Band, {r('Speed_kmh')},
  {r('Recent_Harsh_Events')}, {r('Calculated_Risk_Score')}, {r('Monthly_Premium_USD')} FROM priced""")
def _(v):
    return filters.overview_table(v.priced)


# --- filters ------------------------------------------------------------------
@query("F1_driving_only", f"SELECT event_id, Plate, {r('Speed_kmh')} FROM history WHERE upper(Status) = 'DRIVING'")
def _(v):
    return filters.driving_only(v.history).select("event_id", "Plate", "Speed_kmh")


@query("F2_equality_filter", "SELECT Plate, Make FROM portfolio WHERE Make = 'Toyota'")
def _(v):
    return filters.equals_or_all(v.portfolio, "Make", "Toyota").select("Plate", "Make")


@query("F3_filter_chain", "SELECT Plate, City, Usage FROM portfolio WHERE Type = 'Van' AND Usage = 'Commercial'")
def _(v):
    return filters.filter_chain(v.portfolio, {"Type": "Van", "City": "All", "Usage": "Commercial"}).select(
        "Plate", "City", "Usage")


@query("F3_filter_choices", "SELECT DISTINCT City FROM portfolio WHERE City IS NOT NULL")
def _(v):
    return filters.filter_choices(v.portfolio, "City")


@query("F4_plates_or_all", "SELECT Plate, City FROM portfolio WHERE Plate IN ('V1', 'V2', 'V40')")
def _(v):
    return filters.plates_or_all(v.portfolio, ["V1", "V2", "V40", "none"]).select("Plate", "City")


@query("F4_plates_in_table", "SELECT Plate, City FROM portfolio WHERE Plate IN (SELECT Plate FROM history)")
def _(v):
    return filters.plates_in_table_or_all(v.portfolio, v.history).select("Plate", "City")


@query("F5_one_vehicle", f"SELECT Plate, City, {r('Base_Price_USD')} FROM portfolio WHERE Plate = 'V17'")
def _(v):
    return filters.one_vehicle(v.portfolio, "V17").select("Plate", "City", "Base_Price_USD")


@query("F6_drop_incomplete", "SELECT Plate, Road_Type, Weather FROM portfolio "
       "WHERE Road_Type IS NOT NULL AND Weather IS NOT NULL")
def _(v):
    return filters.drop_incomplete(v.portfolio, ["Road_Type", "Weather"]).select("Plate", "Road_Type", "Weather")


@query("F7_any_flag", "SELECT event_id, Speeding_Flag, Night_Driving_Flag FROM h_prepared "
       "WHERE Speeding_Flag <> 0 OR Night_Driving_Flag <> 0")
def _(v):
    return filters.any_flag(v.h_prepared, ["Speeding_Flag", "Night_Driving_Flag"]).select(
        "event_id", "Speeding_Flag", "Night_Driving_Flag")


@query("F8_fresh_rows", "SELECT event_id, Plate FROM history WHERE Last_Update >= TIMESTAMP '2024-01-29 00:00:00'")
def _(v):
    return filters.fresh_rows(v.history, AS_OF, 3 * 86400).select("event_id", "Plate")


# --- risk expressions -----------------------------------------------------------
@query("R1_vector_bins", f"SELECT event_id, {r('CASE WHEN b IS NULL THEN 0.5e0 ELSE s END', 'score')} FROM "
       f"(SELECT event_id, b, CASE WHEN b < 0 THEN 0.5e0 ELSE {S.bins('b', K.BATTERY_BINS)} END AS s FROM "
       "(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE Acceleration_mps2 + 8.5e0 END AS b FROM history))")
def _(v):
    value = F.when(F.col("event_id") % 9 != 0, F.col("Acceleration_mps2") + 8.5)
    df = v.history.withColumn("b", value)
    return df.select("event_id", risk.vector_bin(F.col("b"), K.BATTERY_BINS, 0.5).alias("score"))


@query("R2_scalar_bins", f"SELECT event_id, {r('CASE WHEN b IS NULL THEN 0.5e0 WHEN b < 0 THEN 0.05e0 ELSE s END', 'score')} FROM "
       f"(SELECT event_id, b, {S.bins('b', K.BATTERY_BINS)} AS s FROM "
       "(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE Acceleration_mps2 + 5e0 END AS b FROM history))")
def _(v):
    value = F.when(F.col("event_id") % 9 != 0, F.col("Acceleration_mps2") + 5.0)
    df = v.history.withColumn("b", value)
    return df.select("event_id", risk.scalar_bin(F.col("b"), K.BATTERY_BINS).alias("score"))


project("R3_speeding_risk", "h_live", "event_id", (), ("Speeding_Risk",))
project("R4_harsh_risk", "h_live", "event_id", (), ("Harsh_Risk",))
project("R5_engine_risk", "h_live", "event_id", (), ("Engine_Risk",))
project("R6_road_time_day_risk", "h_live", "event_id", (),
        ("Road_Type_Risk_Score", "Time_of_Day_Risk_Score", "Day_of_Week_Risk_Score"))
_SCORES = ("Weather_Risk", "Fatigue_Risk", "Exposure_Risk", "Environment_Risk", "Overall_Risk")


def _parts(df):
    filled = Presence(df, risk.ENVIRONMENT_SCORES)
    df = filled.attach(df)
    return df.withColumns({
        "Weather_Risk": risk.weather(df, filled), "Fatigue_Risk": risk.fatigue(df),
        "Exposure_Risk": risk.exposure(df),
        "Environment_Risk": risk.environment(F.col("Road_Type_Risk_Score"), F.col("Time_of_Day_Risk_Score"))})


def _overall(df):
    df = _parts(df)
    return df.withColumn("Overall_Risk", risk.overall(*[F.col(c) for c in (
        "Speeding_Risk", "Harsh_Risk", "Fatigue_Risk", "Weather_Risk", "Exposure_Risk", "Environment_Risk")]))


project("R7_weather_risk", "h_live", "event_id", (), ("Weather_Risk",), spark=_parts)


@query("R6_existing_score", f"""SELECT event_id, {r('CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(event_id % 14 / 1e1, 1e0) END', 'score')} FROM history""")
def _(v):
    df = v.history.withColumn("Road_Type_Risk_Score",
                              F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 14 / F.lit(10.0)))
    return df.select("event_id", risk.road(df, Presence(df, risk.ENVIRONMENT_SCORES)).alias("score"))


@query("R7_weather_by_label", f"SELECT event_id, {r(S.case_map('Weather', K.WEATHER_RISK, 0.30), 'score')} FROM history")
def _(v):
    df = v.history
    return df.select("event_id", risk.weather(df, Presence(df, risk.ENVIRONMENT_SCORES)).alias("score"))


project("R8_fatigue_risk", "h_live", "event_id", (), ("Fatigue_Risk",), spark=_parts)
project("R9_city_risk", "h_live", "event_id", (), ("City_Risk_Score",))
project("R10_exposure_risk", "h_live", "event_id", (), ("Exposure_Risk",), spark=_parts)
project("R11_environment_risk", "h_live", "event_id", (), ("Environment_Risk",), spark=_parts)
project("R12_environmental_risk", "h_live", "event_id", (), ("Environmental_Risk",))
project("R13_vehicle_condition_risk", "live", "Plate", (), ("Vehicle_Condition_Risk",))
project("R14_behavioural_risk", "h_live", "event_id", (), ("Behavioral_Risk",))
project("R15_overall_risk", "h_live", "event_id", (), ("Overall_Risk",), spark=_overall)


@query("R16_smoothing", f"""SELECT event_id, {r('CASE WHEN prior IS NULL THEN s ELSE least(greatest(prior + least(greatest(s - prior, -0.02e0), 0.02e0), 0e0), 1e0) END', 'score', 6)}
  FROM (SELECT event_id, Calculated_Risk_Score AS s, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 / 1e2 END
  AS prior FROM h_live)""", 6)
def _(v):
    prior = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100 / F.lit(100.0))
    df = v.h_live.withColumn("prior", prior)
    return df.select("event_id", risk.smooth(F.col("Calculated_Risk_Score"), F.col("prior")).alias("score"))


@query("R17_risk_band", f"SELECT event_id, {S.band('s')} AS band FROM (SELECT event_id, "
       "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 101 / 1e2 END AS s FROM history)")
def _(v):
    score = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 101 / F.lit(100.0))
    df = v.history.withColumn("s", score)
    return df.select("event_id", risk.band(F.col("s")).alias("band"))


@query("R18_canonical_score", f"""SELECT event_id, {r('s', 'Calculated_Risk_Score', 6)}, {r('s', 'Risk_Score', 6)},
  {r("CASE WHEN event_id % 4 = 0 THEN s ELSE event_id % 100 / 1e2 END", 'LightGBM_Risk_Score', 6)}, {S.band('s')} AS Risk_Band
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5e0 ELSE event_id % 50 / 5e1 END AS s FROM history)""", 6)
def _(v):
    df = v.history.select(
        "event_id", F.lit(None).cast("double").alias("Calculated_Risk_Score"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50 / F.lit(50.0)).alias("Risk_Score"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100 / F.lit(100.0)).alias("LightGBM_Risk_Score"))
    return scoring.canonical_scores(df).select(
        "event_id", "Calculated_Risk_Score", "Risk_Score", "LightGBM_Risk_Score", "Risk_Band")


project("R19_live_outputs", "live", "Plate", ("Risk_Band", "Risk_Action"), (
    "Calculated_Risk_Score", "Risk_Score", "LightGBM_Risk_Score", "Custom_Risk_Score", "Expected_Claim",
    "Speeding_Risk", "Harsh_Risk", "Engine_Risk", "Environmental_Risk", "Vehicle_Condition_Risk", "Behavioral_Risk"))


@query("R20_slot_jitter")
def _(v):
    return scoring.jittered_scores(v.live, AS_OF).select("Plate", "Risk_Score", "Calculated_Risk_Score")


# --- policy and pricing -----------------------------------------------------------
_P1 = S.clip("0.25e0 * least(Recent_Harsh_Events / 5e0, 1e0) + 0.20e0 * Aggressive_Driving_Score"
             " + 0.20e0 * least(Speeding_Excess_kmh / (Base_Road_Max_Speed_kmh + 1e-6), 1e0)"
             " + 0.15e0 * least(greatest(1e0 - Battery_Health_Score / 1e2, 0e0), 1e0)"
             " + 0.15e0 * Coolant_Overheat_Flag + 0.10e0 * Night_Driving_Flag", 0.0, 1.0)


@query("P1_explainable_score", f"SELECT event_id, {r('s', 'LightGBM_Risk_Score', 6)}, {S.band('s')} AS Risk_Band "
       f"FROM (SELECT event_id, {_P1} AS s FROM h_prepared)", 6)
def _(v):
    return scoring.explainable_scores(v.h_prepared).select("event_id", "LightGBM_Risk_Score", "Risk_Band")


@query("P2_cached_scores", f"""SELECT p.Plate, {r('l.s', 'LightGBM_Risk_Score', 6)}, CASE WHEN l.s IS NULL THEN 'Low'
  ELSE {S.band('l.s')} END AS Risk_Band FROM prepared p LEFT JOIN
  (SELECT Plate, max(Calculated_Risk_Score) AS s FROM h_live GROUP BY Plate) l ON p.Plate = l.Plate""", 6)
def _(v):
    cached = v.h_live.groupBy("Plate").agg(F.max("Calculated_Risk_Score").alias("LightGBM_Risk_Score"))
    return scoring.ensure_model_scores(v.prepared, cached=cached).select("Plate", "LightGBM_Risk_Score", "Risk_Band")


project("P3_policy_action", "h_priced", "event_id", ("Risk_Band", "PPO_Action"))
project("P4_policy_multiplier", "h_priced", "event_id", ("PPO_Action",), ("Premium_Multiplier",))
project("P5_daily_premium", "priced", "Plate", (), ("Daily_Premium_USD",))
project("P6_monthly_premium", "priced", "Plate", (), ("Monthly_Premium_USD",))


@query("P6_list_price", f"SELECT Plate, {r(S.case_map('Type', K.BASE_PREMIUM, 8000.0), 'price')} FROM portfolio")
def _(v):
    return v.portfolio.select("Plate", px.list_price(F.col("Type")).alias("price"))


@query("P7_band_multiplier", f"SELECT event_id, {r(S.case_map('Risk_Band', K.BAND_MULTIPLIER, 1.0), 'multiplier')} FROM h_live")
def _(v):
    return v.h_live.select("event_id", px.band_multiplier(F.col("Risk_Band")).alias("multiplier"))


@query("P8_claim_probability", f"SELECT event_id, {r('0.01e0 + Calculated_Risk_Score * 0.44e0', 'probability', 6)} FROM h_live", 6)
def _(v):
    return v.h_live.select("event_id", px.claim_probability(F.col("Calculated_Risk_Score")).alias("probability"))


_BASE = S.case_map("Type", K.BASE_PREMIUM, 600.0)
QUOTE_SQL = f"""SELECT Plate, Risk_Band, PPO_Action, {r('monthly', 'Risk_Based_Monthly_Premium_USD', 2)},
  {r('daily', 'Risk_Based_Daily_Premium_USD', 2)}, {r('monthly * m', 'Policy_Adjusted_Monthly_Premium_USD', 2)},
  {r('daily * m', 'Policy_Adjusted_Daily_Premium_USD', 2)},
  {r('Base_Price_USD * (0.01e0 + s * 0.44e0) * 0.10e0 / 12e0', 'Expected_Claim_USD', 2)},
  CASE WHEN PPO_Action = 'decline' THEN 'declined' ELSE 'quoted' END AS Decision_Status,
  '2024-02-01T00:00:00' AS Decision_Timestamp FROM (SELECT q.*,
  {S.clip('monthly / 3e1', 1.0, 13.33)} AS daily, {S.case_map('PPO_Action', K.POLICY_MULTIPLIER, 1.0)} AS m FROM (
  SELECT p.*, {S.clip(f'{_BASE} * (0.62e0 + s * 1.33e0) / 12e0', 30.0, 400.0)} AS monthly,
  {S.case_map('Risk_Band', K.BAND_POLICY_ACTION, 'standard_offer')} AS PPO_Action FROM (
  SELECT x.*, {S.band('s')} AS Risk_Band FROM (SELECT y.*, {_P1} AS s FROM prepared y) x) p) q)"""


@query("P9_quote", QUOTE_SQL)
def _(v):
    return pricing.quote(v.prepared, AS_OF).select(
        "Plate", "Risk_Band", "PPO_Action", "Risk_Based_Monthly_Premium_USD", "Risk_Based_Daily_Premium_USD",
        "Policy_Adjusted_Monthly_Premium_USD", "Policy_Adjusted_Daily_Premium_USD", "Expected_Claim_USD",
        "Decision_Status", "Decision_Timestamp")


project("P10_profitability", "priced", "Plate", ("Risk_Band", "Recommended_Action"), (
    "Daily_Premium_USD", "Monthly_Premium_USD", "Expected_Claim_USD", "Variable_Expenses_USD", "Control_Cost_USD",
    "Underwriting_Expenses_USD", "Underwriting_Profit_USD"), digits=4)
project("P11_zig_columns", "priced", "Plate", (), (
    "Base_Price_ZIG", "Daily_Premium_ZIG", "Monthly_Premium_ZIG", "Expected_Claim_ZIG", "Variable_Expenses_ZIG",
    "Control_Cost_ZIG", "Underwriting_Expenses_ZIG", "Underwriting_Profit_ZIG"), digits=2)
_MONEY = [c for c in K.SCHEDULE_COLUMNS if c.endswith(("_USD", "_ZIG"))]


@query("P12_premium_schedule", "SELECT Plate, Type, City, Make, Model, Usage, Risk_Band, Recommended_Action, "
       f"{r('Risk_Score', None, 2)}, {', '.join(r(c, None, 2) for c in _MONEY)} FROM priced", 2)
def _(v):
    return pricing.premium_schedule(v.priced)


_P13 = S.clip("2500e0 * (1e0 + Aggressive_Driving_Score * 0.8e0) * (1e0 + Speeding_Ratio_x_Night_Driving_Ratio * 1.2e0)"
              " * Weather_Risk_Score * (1e0 + Fatigue_Risk_Score * 0.6e0)"
              " * (1e0 + least(Recent_Harsh_Events, 1e1) / 1e1 * 0.5e0)", 800.0, 15000.0)


@query("P13_behaviour_claim", f"SELECT event_id, {r(_P13, 'claim')} FROM h_prepared")
def _(v):
    return v.h_prepared.select("event_id", px.behaviour_claim(v.h_prepared).alias("claim"))


MINIMUM = ("CASE WHEN s >= 0.82e0 THEN 3 WHEN s >= 0.66e0 THEN 2 WHEN s >= 0.45e0 THEN 1 ELSE 0 END")


@query("P14_minimum_action", f"SELECT event_id, {MINIMUM} AS action FROM (SELECT event_id, event_id % 101 / 1e2 AS s FROM history)")
def _(v):
    df = v.history.withColumn("s", F.col("event_id") % 101 / F.lit(100.0))
    return df.select("event_id", px.minimum_action(F.col("s")).alias("action"))


def _say(key: str) -> str:
    return S.lit(K.ADVICE[key])


_ADVICE = f"""SELECT Plate, concat_ws('|',
  CASE WHEN Risk_Band IN ('High', 'Critical') THEN {_say('band_high')} WHEN Risk_Band = 'Medium' THEN {_say('band_medium')} ELSE {_say('band_low')} END,
  CASE WHEN Speed_kmh > 110 OR Speeding_Flag = 1 THEN {_say('speeding')} END,
  CASE WHEN Recent_Harsh_Events >= 3 THEN {_say('harsh_many')} WHEN Recent_Harsh_Events >= 1 THEN {_say('harsh_some')} END,
  CASE WHEN Fuel_Efficiency_L_per_100km > 12 THEN {_say('fuel_high')} WHEN Fuel_Efficiency_L_per_100km < 5 THEN {_say('fuel_low')} END,
  CASE WHEN Monthly_Premium_USD >= 75 OR Monthly_Premium_ZIG >= 1000 THEN {_say('premium_high')} WHEN Monthly_Premium_USD > 40 THEN {_say('premium_mid')} ELSE {_say('premium_low')} END,
  CASE WHEN Expected_Claim_USD > 1500 THEN {_say('claim_high')} END,
  CASE WHEN Underwriting_Profit_USD < 0 THEN {_say('profit_negative')} WHEN Monthly_Premium_USD > 0 THEN {_say('profit_ok')} END,
  CASE WHEN Status = 'Driving' THEN {_say('driving')} WHEN Status = 'Parked' THEN {_say('parked')} END,
  CASE WHEN lower(Usage) = 'commercial' THEN {_say('commercial')} END) AS advice FROM priced"""


@query("P15_driver_advice", _ADVICE)
def _(v):
    return v.priced.select("Plate", F.concat_ws("|", px.driver_advice(v.priced)).alias("advice"))


@query("U1_map_quotes", f"SELECT Plate, {r(S.case_map('Type', K.BASE_PREMIUM, 600.0) + ' / 12e0', 'Risk_Based_Monthly_Premium_USD')} FROM portfolio")
def _(v):
    base = dict(K.BASE_PREMIUM)

    def make_scorer():
        def scorer(batch):
            return batch.assign(Risk_Based_Monthly_Premium_USD=batch["Type"].map(base).fillna(600.0) / 12.0)
        return scorer

    return map_quotes(v.portfolio.select("Plate", "Type"), make_scorer).select(
        "Plate", "Risk_Based_Monthly_Premium_USD")
