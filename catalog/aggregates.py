"""Joins, rollups, windows, behaviour tables and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import AS_OF, query, r
from fleetrisk import constants as K
from fleetrisk.operators import behaviour, drivers, features, filters, joins, rollups



def _count(test: str, name: str) -> str:
    return f"count(CASE WHEN {test} THEN 1 END) AS {name}"


# --- joins ----------------------------------------------------------------------
@query("W2_last_rows", f"SELECT Plate, event_id, {r('Speed_kmh')} FROM latest")
def _(v):
    return joins.last_rows(v.history, "Plate", ["Last_Update", "event_id"]).select("Plate", "event_id", "Speed_kmh")


def _live_side(v):
    return v.history.select("Plate", "Last_Update", "event_id", "Speed_kmh", "Weather", "Status", "City")


@query("J1_live_overlay", f"""SELECT p.Plate, {r('CASE WHEN l.Plate IS NULL THEN p.Base_Price_USD ELSE l.Speed_kmh END', 'Speed_kmh')},
  CASE WHEN l.Plate IS NULL THEN 'Clear' ELSE l.Weather END AS Weather, CASE WHEN l.Plate IS NULL THEN p.City ELSE l.City END AS City,
  l.Status AS Status FROM portfolio p LEFT JOIN latest l ON p.Plate = l.Plate""")
def _(v):
    base = v.portfolio.select("Plate", F.col("Base_Price_USD").alias("Speed_kmh"), F.lit("Clear").alias("Weather"), "City")
    out = joins.refresh_live_columns(base, _live_side(v), ["Last_Update", "event_id"])
    return out.select("Plate", "Speed_kmh", "Weather", "City", "Status")


@query("J2_schedule_overlay", """SELECT p.Plate, CASE WHEN l.Plate IS NULL THEN p.Make ELSE l.City END AS Make
  FROM portfolio p LEFT JOIN latest l ON p.Plate = l.Plate""")
def _(v):
    live = v.history.select("Plate", F.col("City").alias("Make"), "Last_Update", "event_id")
    return joins.overlay(v.portfolio.select("Plate", "Make"), live, ("Make", "Model"), ["Last_Update", "event_id"])


@query("J3_raw_sync", f"""SELECT p.Plate, CASE WHEN l.Plate IS NULL THEN p.City ELSE l.City END AS City,
  {r('CASE WHEN l.Plate IS NULL THEN p.RPM ELSE l.RPM END', 'RPM')} FROM portfolio p LEFT JOIN latest l ON p.Plate = l.Plate""")
def _(v):
    raw = v.history.select("Plate", "City", "RPM", "Last_Update", "event_id")
    return joins.sync_with_raw(v.portfolio.select("Plate", "City", "RPM"), raw, ["Last_Update", "event_id"])


_LAT, _LON = ({c: p[i] for c, p in K.CITY_CENTROIDS.items()} for i in (0, 1))


@query("J4_city_centroids", f"""SELECT City, {r(f"coalesce(a, {S.case_map('City', _LAT, None)})", 'lat')},
  {r(f"coalesce(b, {S.case_map('City', _LON, None)})", 'lon')} FROM (SELECT City,
  avg(CASE WHEN c_custkey % 2 = 0 AND City <> 'Gweru' THEN GPS_Latitude END) AS a,
  avg(CASE WHEN c_custkey % 2 = 0 AND City <> 'Gweru' THEN GPS_Longitude END) AS b FROM portfolio GROUP BY City)""")
def _(v):
    known = (F.col("c_custkey") % 2 == 0) & (F.col("City") != "Gweru")
    return joins.city_centroids(v.portfolio.withColumn("GPS_Latitude", F.when(known, F.col("GPS_Latitude"))))


@query("J5_score_lookup", f"SELECT p.Plate, {r('l.Speed_kmh', 'score')} FROM portfolio p LEFT JOIN latest l ON p.Plate = l.Plate")
def _(v):
    scored = v.history.select("Plate", F.col("Speed_kmh").alias("score"), "Last_Update", "event_id")
    return joins.score_lookup(v.portfolio.select("Plate"), scored, "score", ["Last_Update", "event_id"])


@query("J6_update_while_driving", f"""SELECT p.Plate, {r("CASE WHEN lower(p.Status) = 'driving' AND l.Speed_kmh IS NOT NULL THEN l.Speed_kmh ELSE p.Base_Price_USD END", 'Risk_Score')}
  FROM portfolio p LEFT JOIN latest l ON p.Plate = l.Plate""")
def _(v):
    base = v.portfolio.select("Plate", "Status", F.col("Base_Price_USD").alias("Risk_Score"))
    live = v.history.select("Plate", F.col("Speed_kmh").alias("Risk_Score"), "Last_Update", "event_id")
    return joins.update_while_driving(base, live, "Risk_Score", ["Last_Update", "event_id"]).select("Plate", "Risk_Score")


@query("J7_prior_state", """SELECT p.Plate, s.severity AS prior_severity, s.last_updated AS prior_updated FROM portfolio p LEFT JOIN
  (SELECT Plate, CASE WHEN max(event_id) % 2 = 0 THEN 'High' ELSE 'Low' END AS severity, max(Last_Update) AS last_updated
   FROM history GROUP BY Plate) s ON p.Plate = s.Plate""")
def _(v):
    state = v.history.groupBy(F.col("Plate").alias("plate")).agg(
        F.when(F.max("event_id") % 2 == 0, "High").otherwise("Low").alias("severity"),
        F.max("Last_Update").alias("last_updated"), F.max("Speed_kmh").alias("composite_score"))
    return joins.with_prior_state(v.portfolio.select("Plate"), state).select("Plate", "prior_severity", "prior_updated")


@query("J8_order_like", "SELECT Plate, City FROM portfolio")
def _(v):
    return joins.order_like(v.portfolio.select("Plate", "City"), v.history, "event_id")


@query("J9_positional_overlay", f"SELECT c.c_custkey, {r('CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal ELSE s.s_acctbal END', 'balance')} "
       "FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def _(v):
    base = v.table("customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    live = v.table("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return joins.positional_overlay(base, live, ["balance"], "c_custkey")


@query("J10_lookup_map", f"SELECT event_id, {r(S.case_map('Weather', K.WEATHER_RISK, 0.30), 'score')} FROM history")
def _(v):
    from fleetrisk.functions.columns import lookup
    return v.history.select("event_id", lookup(K.WEATHER_RISK, F.col("Weather"), 0.30).alias("score"))


@query("X1_stack_frames", f"SELECT Plate, City, {r('Speed_kmh')}, NULL::VARCHAR AS Type FROM history UNION ALL "
       "SELECT Plate, City, NULL::DOUBLE, Type FROM portfolio")
def _(v):
    return joins.stack_frames([v.history.select("Plate", "City", "Speed_kmh"), v.portfolio.select("Plate", "City", "Type")])


@query("X2_plates_in_both", "SELECT DISTINCT Plate FROM portfolio WHERE Plate IN (SELECT Plate FROM history)")
def _(v):
    return joins.plates_in_both(v.portfolio, v.history)


@query("X3_distinct_keys", "SELECT DISTINCT Plate FROM history WHERE Plate IS NOT NULL")
def _(v):
    return filters.filter_choices(v.history, "Plate")


# --- rollups ---------------------------------------------------------------------
@query("G2_risk_kpis", f"""SELECT count(*) AS total_vehicles, {r('avg(Calculated_Risk_Score)', 'avg_risk_score')},
  {', '.join(_count(f"Risk_Band = '{b}'", b.lower() + '_count') for b in K.BANDS)},
  {', '.join(r(f"count(CASE WHEN Risk_Band = '{b}' THEN 1 END) * 1e0 / count(*)", b.lower() + '_pct') for b in K.BANDS)},
  {_count("Risk_Band IN ('High', 'Critical')", 'high_risk_count')}, {_count("Risk_Band = 'Critical'", 'critical_risk_count')},
  {r('sum(Expected_Claim)', 'expected_claim_total', 2)}, {r('avg(Expected_Claim)', 'expected_claim_avg', 2)},
  {r('median(Calculated_Risk_Score)', 'median_risk_score')} FROM priced""")
def _(v):
    from catalog.registry import settled
    return settled(rollups.risk_kpis(v.priced), {"expected_claim_total": 2, "expected_claim_avg": 2})


@query("G2_review_actions", "SELECT Risk_Action, count(*) AS Count FROM live GROUP BY Risk_Action")
def _(v):
    return rollups.review_action_counts(v.live)


_RESCORE = f"""SELECT q.*, {S.band('s2')} AS b2 FROM (SELECT p.*, least(greatest({S.surcharged(
    'least(greatest(Calculated_Risk_Score + least(greatest(Overall_Risk - Calculated_Risk_Score, -0.02e0), 0.02e0), 0e0), 1e0)')}, 0e0), 1e0) AS s2
  FROM priced p) q"""


@query("G3_band_summary", f"""SELECT b2 AS Risk_Band, count(Plate) AS Vehicles, {r('avg(s2)', 'Avg_Risk_Score')},
  {r('sum(Expected_Claim)', 'Total_Expected_Claim', 2)}, {r('avg(Expected_Claim)', 'Avg_Expected_Claim', 2)}
  FROM ({_RESCORE}) GROUP BY b2""")
def _(v):
    from catalog.registry import settled
    return settled(rollups.band_summary(v.priced), {"Total_Expected_Claim": 2, "Avg_Expected_Claim": 2})


@query("G4_city_summary", f"""SELECT a.City, a.Vehicles, {r('a.s', '"Calculated_Risk_Score(avg)"')}, b.Risk_Band FROM
  (SELECT City, count(Plate) AS Vehicles, avg(Calculated_Risk_Score) AS s FROM live GROUP BY City) a JOIN
  (SELECT City, Risk_Band FROM (SELECT City, Risk_Band, row_number() OVER (PARTITION BY City ORDER BY count(*) DESC, Risk_Band)
   AS rn FROM live GROUP BY City, Risk_Band) WHERE rn = 1) b ON a.City = b.City""")
def _(v):
    return rollups.city_summary(v.live)


@query("G5_city_risk_premium", f"""SELECT a.City, a.n AS Vehicle_Count, {r('a.s', 'Avg_Risk_Score', 3)}, {r('a.p', 'Avg_Premium', 2)}, b.Risk_Level FROM
  (SELECT City, count(Plate) AS n, avg(Calculated_Risk_Score) AS s, avg(Monthly_Premium_USD) AS p FROM priced GROUP BY City) a JOIN
  (SELECT City, Risk_Band AS Risk_Level FROM (SELECT City, Risk_Band, row_number() OVER (PARTITION BY City ORDER BY count(*) DESC, Risk_Band)
   AS rn FROM priced GROUP BY City, Risk_Band) WHERE rn = 1) b ON a.City = b.City""")
def _(v):
    return rollups.city_risk_premium(v.priced)


@query("G6_premium_by_city", f"""SELECT City, {r('t', 'Total_Monthly_Premium_USD', 2)}, {r('a', 'Avg_Monthly_Premium_USD', 2)}, n AS Vehicle_Count,
  {r('g', 'Avg_Aggressive_Score', 2)}, {r('k', 'Avg_Speed_kmh', 2)}, {r('t', 'Total_Premium', 2)}, {r('a', 'Avg_Premium', 2)}, {r('k', 'Avg_Speed', 2)} FROM
  (SELECT City, sum(Monthly_Premium_USD) AS t, avg(Monthly_Premium_USD) AS a, count(Monthly_Premium_USD) AS n,
   avg(Aggressive_Driving_Score) AS g, avg(Speed_kmh) AS k FROM priced GROUP BY City)""", 2)
def _(v):
    return rollups.premium_by_city(v.priced)


@query("G7_premium_by_band", f"""SELECT Risk_Band, {r('sum(Monthly_Premium_USD)', 'Total_Premium', 2)}, {r('avg(Monthly_Premium_USD)', 'Avg_Premium', 2)},
  count(Monthly_Premium_USD) AS Vehicle_Count, {r('avg(Aggressive_Driving_Score)', 'Avg_Aggressive_Score', 2)} FROM h_priced GROUP BY Risk_Band""", 2)
def _(v):
    return rollups.premium_by_band(v.h_priced)


@query("G8_band_analysis", f"""SELECT Risk_Band, count(*) AS Vehicle_Count, {r('avg(Monthly_Premium_USD)', 'Avg_Premium', 2)},
  {r('sum(Monthly_Premium_USD)', 'Total_Premium', 2)}, {r('avg(Underwriting_Profit_USD)', 'Avg_Profit', 2)},
  {r('sum(Underwriting_Profit_USD)', 'Total_Profit', 2)} FROM h_priced GROUP BY Risk_Band""", 2)
def _(v):
    return rollups.band_analysis(v.h_priced)


_CITY_TABLE = f"""SELECT City, count(DISTINCT Plate) AS Vehicle_Count, count(CASE WHEN lower(Status) <> 'parked' THEN 1 END) AS Active_Vehicles,
  {r('avg(Risk_Score)', 'Avg_Risk_Score', 3)}, {r('avg(Monthly_Premium_USD)', 'Avg_Monthly_Premium_USD', 2)},
  {r('sum(Monthly_Premium_USD)', 'Total_Monthly_Premium_USD', 2)}, {r('avg(Monthly_Premium_ZIG)', 'Avg_Monthly_Premium_ZIG', 2)},
  {r('sum(Monthly_Premium_ZIG)', 'Total_Monthly_Premium_ZIG', 2)}, {r('sum(Expected_Claim_USD)', 'Total_Expected_Claims', 2)},
  {r('sum(Underwriting_Profit_USD)', 'Total_Profit', 2)}, {r('avg(Speed_kmh)', 'Avg_Speed_kmh', 1)},
  {r('avg(GPS_Latitude)', 'lat', 5)}, {r('avg(GPS_Longitude)', 'lon', 5)}, {S.band('avg(Risk_Score)')} AS Risk_Level,
  {r('count(DISTINCT Plate) * 1e0 / (SELECT count(DISTINCT Plate) FROM priced) * 1e2', 'Vehicle_Share_Pct', 1)} FROM priced GROUP BY City"""


@query("G9_city_analytics", _CITY_TABLE, 5)
def _(v):
    return rollups.city_analytics(v.priced)


_SUMS = ", ".join(f"sum({c}_{cur}) AS {c}_{cur}" for c in ("Monthly_Premium", "Expected_Claim", "Underwriting_Expenses")
                  for cur in ("USD", "ZIG"))
_PROFIT = {cur: f"(Monthly_Premium_{cur} - Expected_Claim_{cur} - Underwriting_Expenses_{cur})" for cur in ("USD", "ZIG")}
_METRICS = (
    ("Total Vehicles", "n"), ("Total Monthly Premium ($)", "Monthly_Premium_USD"), ("Total Monthly Premium (ZIG)", "Monthly_Premium_ZIG"),
    ("Total Expected Claims ($)", "Expected_Claim_USD"), ("Total Expected Claims (ZIG)", "Expected_Claim_ZIG"),
    ("Total Expenses ($)", "Underwriting_Expenses_USD"), ("Total Expenses (ZIG)", "Underwriting_Expenses_ZIG"),
    ("Total Monthly Profit ($)", _PROFIT["USD"]), ("Total Monthly Profit (ZIG)", _PROFIT["ZIG"]),
    ("Average Premium per Vehicle ($)", "Monthly_Premium_USD / n"), ("Average Profit per Vehicle ($)", f"{_PROFIT['USD']} / n"),
    ("Average Profit per Vehicle (ZIG)", f"{_PROFIT['ZIG']} / n"), ("Profit Margin (%)", f"{_PROFIT['USD']} / Monthly_Premium_USD * 1e2"),
)


@query("G10_portfolio_profitability", "WITH totals AS MATERIALIZED (SELECT count(*) AS n, " + _SUMS + " FROM priced) " + " UNION ALL ".join(
    f"SELECT '{name}' AS Metric, {r(expr, 'Value', 2)} FROM totals" for name, expr in _METRICS), 2)
def _(v):
    return rollups.portfolio_profitability(v.priced)


_CLAIM13 = S.clip("2500e0 * (1e0 + Aggressive_Driving_Score * 0.8e0) * (1e0 + Speeding_Ratio_x_Night_Driving_Ratio * 1.2e0)"
                  " * Weather_Risk_Score * (1e0 + Fatigue_Risk_Score * 0.6e0)"
                  " * (1e0 + least(Recent_Harsh_Events, 1e1) / 1e1 * 0.5e0)", 800.0, 15000.0)


@query("G11_premium_kpis", f"""SELECT {r('sum(Monthly_Premium_USD)', 'total_premium', 2)}, {r('avg(Monthly_Premium_USD)', 'avg_premium', 2)},
  {_count("Risk_Band = 'Critical'", 'high_risk_count')}, {_count("Risk_Band = 'Low'", 'low_risk_count')},
  {r(f'sum({_CLAIM13})', 'expected_claims', 2)}, {r('median(Monthly_Premium_USD)', 'median_premium', 2)},
  {r(f'least(sum({_CLAIM13}) / sum(Monthly_Premium_USD), 2e0)', 'loss_ratio', 2)} FROM priced""", 2)
def _(v):
    return rollups.premium_kpis(v.priced)


_SUMMARY = f"""count(*) AS record_count, count(*) AS quoted_count, CAST(0 AS BIGINT) AS declined_count,
  {_count("Risk_Band IN ('High', 'Critical')", 'high_risk_count')}, {_count("Risk_Band = 'Critical'", 'critical_risk_count')},
  {r('avg(LightGBM_Risk_Score)', 'avg_model_risk_score')}, {r('avg(Calculated_Risk_Score)', 'avg_calculated_risk_score')},
  {r('avg(Monthly_Premium_USD)', 'avg_monthly_premium_usd')}, {r('sum(Monthly_Premium_USD)', 'total_monthly_premium_usd')}"""


@query("G12_live_summary", f"SELECT {_SUMMARY} FROM priced")
def _(v):
    return rollups.live_summary(v.priced)


@query("G12_bundle_summary", f"""SELECT 'portfolio' AS source_name, false AS trained_models_available, {_SUMMARY},
  {r('sum(Expected_Claim_USD)', 'total_expected_claim_usd')}, {r('sum(Underwriting_Profit_USD)', 'total_underwriting_profit_usd')} FROM priced""")
def _(v):
    return rollups.bundle_summary(v.priced, "portfolio")


@query("G13_overview_kpis", f"""SELECT count(*) AS total_vehicles, {r('avg(Calculated_Risk_Score)', 'avg_risk_score')},
  {_count("Risk_Band IN ('High', 'Critical')", 'high_risk_count')}, {_count("Risk_Band = 'Low'", 'low_risk_count')},
  {r('sum(Monthly_Premium_USD)', 'total_premium')}, {r('avg(Monthly_Premium_USD)', 'avg_premium')}, {r('avg(Speed_kmh)', 'avg_speed')},
  {r('avg(Recent_Harsh_Events)', 'avg_harsh_events')}, {r('avg(Fuel_Efficiency_L_per_100km)', 'avg_fuel_efficiency')},
  {r('avg(Trip_Distance_km)', 'avg_trip_distance')}, CAST(sum(Speeding_Flag) AS BIGINT) AS vehicles_speeding,
  {r('sum(Recent_Harsh_Events)', 'total_harsh_events')} FROM priced""")
def _(v):
    return rollups.overview_kpis(v.priced)


@query("G13_live_telemetry_kpis", f"""SELECT {r('avg(Speed_kmh)', 'avg_speed')}, {r('avg(Acceleration_mps2)', 'avg_acceleration')},
  {r('avg(Engine_Load_pct)', 'avg_engine_load')}, {r('avg(Battery_V)', 'avg_battery_voltage')}, {r('avg(Fuel_Efficiency_L_per_100km)', 'avg_fuel_efficiency')},
  {_count("Status = 'Driving'", 'vehicles_driving')}, CAST(sum(Speeding_Flag) AS BIGINT) AS speeding_vehicles,
  {_count('Calculated_Risk_Score > 0.75e0', 'high_risk_vehicles')}, {_count("Status <> 'Parked'", 'current_active_vehicles')} FROM h_live""")
def _(v):
    return rollups.live_telemetry_kpis(v.h_live)


@query("G14_action_counts", "SELECT PPO_Action, count(*) AS Vehicle_Count FROM h_priced GROUP BY PPO_Action")
def _(v):
    return rollups.action_counts(v.h_priced)


@query("G15_value_counts", "SELECT coalesce(Status, 'Unknown') AS Status, count(*) AS Count FROM portfolio GROUP BY 1")
def _(v):
    return rollups.value_counts(v.portfolio, "Status", "Unknown")


@query("G15_band_counts", "SELECT Risk_Band, count(*) AS Count FROM h_live GROUP BY 1")
def _(v):
    return rollups.value_counts(v.h_live, "Risk_Band")


@query("G16_chooser", f"SELECT City, Type, {r('max(Monthly_Premium_USD)', 'Monthly_Premium_USD')} FROM priced GROUP BY City, Type")
def _(v):
    return rollups.chooser(v.priced, "City", "Monthly_Premium_USD", "Max", "Type")


@query("G17_mean_by", f"SELECT Make, {r('avg(Base_Price_USD)', 'Base_Price_USD')} FROM portfolio GROUP BY Make")
def _(v):
    return behaviour.mean_by(v.portfolio, "Make", "Base_Price_USD")


def _behaviour_sql() -> str:
    cells = []
    for m in behaviour.BEHAVIOUR_METRICS:
        cells += [r(f"avg({m})", f"{m}_mean", 2), r(f"stddev_samp({m})", f"{m}_std", 2),
                  r(f"CASE WHEN var_samp({m}) > 0 THEN skewness({m}) ELSE 0e0 END", f"{m}_skew", 2), r(f"median({m})", f"{m}_median", 2)]
    return f"SELECT City AS Type, {', '.join(cells)} FROM h_prepared GROUP BY City"


@query("G18_behaviour_by_type", _behaviour_sql(), 2)
def _(v):
    return behaviour.behaviour_by_type(v.h_prepared.drop("Type").withColumnRenamed("City", "Type"))


@query("G19_harsh_totals", " UNION ALL ".join(f"SELECT '{label}' AS Event_Type, CAST(sum({c}) AS BIGINT) AS Count FROM history" for c, label in (
    ("Harsh_Brake_Count", "Harsh Braking"), ("Harsh_Accel_Count", "Harsh Acceleration"), ("Harsh_Corner_Count", "Harsh Cornering"))))
def _(v):
    return behaviour.harsh_totals(v.history)


@query("G19_harsh_by_type", f"""SELECT Type, {r('avg(Harsh_Brake_Count)', 'Harsh_Brake_Count')}, {r('avg(Harsh_Accel_Count)', 'Harsh_Accel_Count')},
  {r('avg(Harsh_Corner_Count)', 'Harsh_Corner_Count')} FROM prepared GROUP BY Type""")
def _(v):
    return behaviour.harsh_by_type(v.prepared)


@query("G20_city_distribution", f"SELECT City, {r('avg(Risk_Score)', 'Avg_Risk_Score')}, count(DISTINCT Plate) AS Vehicle_Count FROM h_live GROUP BY City")
def _(v):
    return rollups.city_distribution(v.h_live)


@query("G20_band_city_counts", "SELECT Risk_Band, City, count(DISTINCT Plate) AS Vehicle_Count FROM h_live GROUP BY Risk_Band, City")
def _(v):
    return rollups.band_city_counts(v.h_live)


@query("G21_status_shares", f"""SELECT count(*) AS total_vehicles, {_count("Status = 'Driving'", 'driving_count')}, {_count("Status = 'Parked'", 'parked_count')},
  {r("count(CASE WHEN Status = 'Driving' THEN 1 END) * 1e0 / count(*) * 1e2", 'driving_pct')},
  {r("count(CASE WHEN Status = 'Parked' THEN 1 END) * 1e0 / count(*) * 1e2", 'parked_pct')} FROM history""")
def _(v):
    return rollups.status_shares(v.history)


@query("G23_exploded_counts", """SELECT CASE WHEN trim(i) = '' THEN 'Unknown' ELSE trim(i) END AS Fraud_Type, count(*) AS Count FROM
  (SELECT unnest(string_split(City || ', ' || coalesce(Weather, '') || ',' || Status, ',')) AS i FROM history) GROUP BY 1""")
def _(v):
    df = v.history.select(F.concat("City", F.lit(", "), F.coalesce("Weather", F.lit("")), F.lit(","), "Status").alias("t"))
    return behaviour.exploded_counts(df, "t")


def _edges(bins: int) -> str:
    return f"(hi - lo) / {bins}e0"


def _bin(value: str, bins: int, test: str) -> str:
    """Bin number as the count of inner edges on the low side of the value."""
    return " + ".join(f"CASE WHEN lo + {i}e0 * ({_edges(bins)}) {test} {value} THEN 1 ELSE 0 END" for i in range(1, bins))


def _heat(measure: str) -> str:
    return f"""WITH span AS (SELECT min(Recent_Avg_Speed) AS lo, max(Recent_Avg_Speed) AS hi, least(max(CAST(Recent_Harsh_Events AS INT)), 10) AS top FROM h_live),
  cells AS (SELECT least(CAST(Recent_Harsh_Events AS INT), top) AS h, {_bin('Recent_Avg_Speed', 8, '<')} AS b,
    Calculated_Risk_Score AS s FROM h_live, span),
  grid AS (SELECT h, b FROM (SELECT unnest(range(0, top + 1)) AS h FROM span), (SELECT unnest(range(0, 8)) AS b))
  SELECT CAST(g.h AS INT) AS Harsh_Capped, CAST(g.b AS INT) AS Speed_Bin, CAST(CAST(round_even(lo + g.b * ({_edges(8)}), 0) AS INT) AS VARCHAR) || '-' ||
    CAST(CAST(round_even(CASE WHEN g.b = 7 THEN hi ELSE lo + (g.b + 1) * ({_edges(8)}) END, 0) AS INT) AS VARCHAR) AS Speed_Label, {measure} AS Value
  FROM grid g LEFT JOIN cells c ON g.h = c.h AND g.b = c.b, span GROUP BY g.h, g.b, lo, hi"""


@query("G24_harsh_speed_heatmap", _heat("count(c.h)"))
def _(v):
    return behaviour.harsh_speed_heatmap(v.h_live)


@query("G24_mean_score_heatmap", _heat(S.rounded("avg(c.s)", 4)))
def _(v):
    return behaviour.harsh_speed_heatmap(v.h_live, how="Mean Risk Score")


def _hour_bins() -> str:
    tests = []
    for i, label in enumerate(behaviour.SPEED_LABELS):
        low, high = behaviour.SPEED_EDGES[i], behaviour.SPEED_EDGES[i + 1]
        tests.append(f"count(CASE WHEN Speed_kmh {'>=' if i == 0 else '>'} {low} AND Speed_kmh <= {high} THEN 1 END) AS \"{label}\"")
    return f"SELECT CAST(t.h AS INT) AS hour, {', '.join(tests)} FROM (SELECT unnest(range(0, 24)) AS h) t LEFT JOIN history e ON hour(e.Last_Update) = t.h GROUP BY t.h"


@query("G25_hour_speed_heatmap", _hour_bins())
def _(v):
    return behaviour.hour_speed_heatmap(v.history)


@query("G26_histogram", f"""WITH span AS (SELECT min(Speed_kmh) AS lo, max(Speed_kmh) AS hi FROM history),
  cells AS (SELECT {_bin('Speed_kmh', 30, '<=')} AS b FROM history, span)
  SELECT CAST(g.b AS INT) AS Bin, {r(f'((lo + g.b * ({_edges(30)})) + (CASE WHEN g.b = 29 THEN hi ELSE lo + (g.b + 1) * ({_edges(30)}) END)) / 2e0', 'Centre')}, count(c.b) AS Count
  FROM (SELECT unnest(range(0, 30)) AS b) g LEFT JOIN cells c ON g.b = c.b, span GROUP BY g.b, lo, hi""")
def _(v):
    return behaviour.histogram(v.history, "Speed_kmh")


@query("G27_describe", f"""SELECT count(Speed_kmh) * 1e0 AS count, {r('avg(Speed_kmh)', 'mean', 2)}, {r('stddev_samp(Speed_kmh)', 'std', 2)}, {r('min(Speed_kmh)', 'min', 2)},
  {r('max(Speed_kmh)', 'max', 2)}, {r('quantile_cont(Speed_kmh, 0.25)', 'q25', 2)}, {r('quantile_cont(Speed_kmh, 0.5)', 'q50', 2)}, {r('quantile_cont(Speed_kmh, 0.75)', 'q75', 2)} FROM history""", 2)
def _(v):
    return behaviour.describe(v.history, "Speed_kmh")


_CORR = ("Risk_Score", "Speeding_Excess_kmh", "Aggressive_Driving_Score", "Engine_Load_pct", "RPM", "MAF_gs")


@query("G28_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {r(f'coalesce(corr({min(a, b)}, {max(a, b)}), 0e0)', 'correlation')} FROM h_live" for a in _CORR for b in _CORR))
def _(v):
    return behaviour.correlation_matrix(v.h_live, _CORR)


@query("G29_premium_trend_lines", f"""SELECT Risk_Band, count(*) AS n, {r('regr_slope(Monthly_Premium_USD, Calculated_Risk_Score)', 'slope', 2)},
  {r('regr_intercept(Monthly_Premium_USD, Calculated_Risk_Score)', 'intercept', 2)}, {r('regr_r2(Monthly_Premium_USD, Calculated_Risk_Score)', 'r2', 2)} FROM priced GROUP BY Risk_Band""", 2)
def _(v):
    return behaviour.premium_trend_lines(v.priced)


@query("G30_speed_trend", f"""SELECT date_trunc('day', Last_Update) + to_seconds(CAST(floor(epoch(Last_Update - date_trunc('day', Last_Update)) / w) * w AS INT)) AS Last_Update,
  {r('avg(Speed_kmh)', 'Speed_kmh')} FROM history, (SELECT CASE WHEN epoch(max(Last_Update) - min(Last_Update)) / 3600e0 > 72 THEN 43200
  WHEN epoch(max(Last_Update) - min(Last_Update)) / 3600e0 > 24 THEN 3600 ELSE 1800 END AS w FROM history) GROUP BY 1""")
def _(v):
    return behaviour.speed_trend(v.history)


@query("G31_geospatial_headline", f"""WITH t AS ({_CITY_TABLE}) SELECT count(*) AS active_cities, {r('avg(Avg_Risk_Score)', 'avg_city_risk')},
  (SELECT City FROM t ORDER BY Avg_Risk_Score DESC, Total_Monthly_Premium_USD DESC LIMIT 1) AS top_risk_city, {r('max(Avg_Risk_Score)', 'top_risk_score')},
  (SELECT City FROM t ORDER BY Total_Profit DESC LIMIT 1) AS top_profit_city, {r('max(Total_Profit)', 'top_profit')} FROM t""")
def _(v):
    return rollups.geospatial_headline(rollups.city_analytics(v.priced))


@query("G32_fingerprint")
def _(v):
    return rollups.fingerprint(v.history)


# --- driver statistics and windows ---------------------------------------------------
def _driver_sql(source: str, order: str, lookback: int | None, night: str) -> str:
    kept = f"WHERE rn <= {lookback}" if lookback else ""
    desc = ", ".join(f"{c} DESC" for c in order.split(", "))
    return f"""WITH n AS (SELECT h.*, Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count AS harsh, {night} AS night,
    row_number() OVER (PARTITION BY Plate ORDER BY {desc}) AS rn FROM {source} h WHERE Last_Update IS NOT NULL),
  k AS (SELECT n.*, harsh - lag(harsh) OVER w AS dh, Trip_Distance_km - lag(Trip_Distance_km) OVER w AS dk FROM n {kept}
    WINDOW w AS (PARTITION BY Plate ORDER BY {order})),
  i AS (SELECT k.*, CASE WHEN dh IS NULL THEN harsh ELSE greatest(dh, 0) END AS hi,
    CASE WHEN dk IS NULL THEN Trip_Distance_km ELSE greatest(dk, 0e0) END AS ki FROM k)
  SELECT Plate, count(*) AS observation_count, min(Last_Update) AS window_start, max(Last_Update) AS window_end,
    arg_min(City, rn) FILTER (WHERE City IS NOT NULL) AS latest_city, arg_min(Status, rn) FILTER (WHERE Status IS NOT NULL) AS latest_status,
    {r('avg(Speed_kmh)', 'avg_speed_kmh')}, {r('coalesce(stddev_samp(Speed_kmh), 0e0)', 'speed_std_kmh')}, {r('max(Speed_kmh)', 'max_speed_kmh')},
    {r('avg(Acceleration_mps2)', 'avg_acceleration_mps2')}, {r('sum(hi)', 'harsh_event_total')}, {r('max(harsh)', 'latest_harsh_event_total')},
    {r('avg(Speeding_Flag)', 'speeding_event_rate')}, {r('sum(ki * night)', 'night_distance_km')}, {r('sum(ki)', 'trip_distance_km')},
    {r('avg(Engine_Load_pct)', 'avg_engine_load_pct')}, {r('max(Coolant_Temp_C)', 'max_coolant_temp_c')} FROM i GROUP BY Plate"""


_NIGHT = "CASE WHEN Time_of_Day IN ('Night', 'Late Night', 'Dawn') THEN 1 ELSE 0 END"
_SUPPLY = ("(SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS Plate, l_shipdate AS Last_Update, l_orderkey, l_linenumber, "
           "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus END AS City, CASE WHEN l_returnflag = 'R' THEN 'Parked' ELSE 'Driving' END AS Status, "
           "l_quantity * 4e0 AS Speed_kmh, (l_orderkey * 7 % 128) / 8e0 - 8e0 AS Acceleration_mps2, CAST(l_orderkey * 13 % 100 AS DOUBLE) AS Engine_Load_pct, "
           "CAST(70 + l_orderkey * 11 % 45 AS DOUBLE) AS Coolant_Temp_C, CAST(l_orderkey * 17 % 60 AS DOUBLE) AS Trip_Distance_km, "
           "CAST(l_orderkey % 4 AS INT) AS Harsh_Brake_Count, CAST(l_linenumber % 3 AS INT) AS Harsh_Accel_Count, CAST(l_orderkey % 5 AS INT) AS Harsh_Corner_Count, "
           "CAST(l_linenumber % 2 AS INT) AS Night_Driving_Flag, CAST(CASE WHEN l_quantity > 2e1 THEN 1 ELSE 0 END AS INT) AS Speeding_Flag FROM lineitem)")


@query("G1_driver_statistics", _driver_sql("history", "Last_Update, event_id", 120, _NIGHT))
def _(v):
    return drivers.driver_statistics(v.history, tiebreak=["event_id"])


@query("G1_supply_statistics", _driver_sql(_SUPPLY, "Last_Update, l_orderkey, l_linenumber", 120, "Night_Driving_Flag"))
def _(v):
    return drivers.driver_statistics(v.supply, tiebreak=["l_orderkey", "l_linenumber"])


@query("G1_whole_history", _driver_sql(_SUPPLY, "Last_Update, l_orderkey, l_linenumber", None, "Night_Driving_Flag"))
def _(v):
    return drivers.driver_statistics(v.supply, tiebreak=["l_orderkey", "l_linenumber"], lookback=None)


@query("W1_increments", f"""SELECT event_id, {r('CASE WHEN dh IS NULL THEN harsh ELSE greatest(dh, 0) END', 'harsh_increment')},
  {r('CASE WHEN dk IS NULL THEN Trip_Distance_km ELSE greatest(dk, 0e0) END', 'distance_increment')} FROM (SELECT k.*,
  harsh - lag(harsh) OVER w AS dh, Trip_Distance_km - lag(Trip_Distance_km) OVER w AS dk FROM
  (SELECT h.*, Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count AS harsh FROM history h) k
  WINDOW w AS (PARTITION BY Plate ORDER BY Last_Update, event_id))""")
def _(v):
    return drivers.driver_increments(v.history, tiebreak=["event_id"], lookback=None).select(
        "event_id", "harsh_increment", "distance_increment")


@query("W3_lookback", "SELECT Plate, event_id FROM (SELECT Plate, event_id, row_number() OVER "
       "(PARTITION BY Plate ORDER BY Last_Update DESC, event_id DESC) AS rn FROM history) WHERE rn <= 40")
def _(v):
    return drivers.last_n_rows(v.history, 40, tiebreak=["event_id"]).select("Plate", "event_id")


@query("W4_row_numbers", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_number FROM customer")
def _(v):
    from fleetrisk.operators.ranks import dense_numbers
    return dense_numbers(v.table("customer").select("c_custkey"), "row_number", "c_custkey")


_RANGE = "(PARTITION BY Plate ORDER BY Last_Update RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND CURRENT ROW)"


@query("W5_rolling_speed", f"SELECT Plate, event_id, {r('avg(Speed_kmh) OVER ' + _RANGE.format(7), 'Avg_Speed_Last_7_Days', 8)} FROM history", 8)
def _(v):
    return drivers.rolling_speed(v.history, "event_id")


@query("W5_rolling_harsh", f"""SELECT Plate, event_id, {r('sum(Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count) OVER ' + _RANGE.format(30), 'Total_Harsh_Events_Last_30_Days', 3)} FROM history""", 3)
def _(v):
    return drivers.rolling_harsh(v.history, "event_id")


_TRAILING = _RANGE.format(30)


@query("W5_trailing_extremes", f"""SELECT Plate, event_id, {r(f'max(Speed_kmh) OVER {_TRAILING}', 'Max_Speed_kmh', 6)}, {r(f'sqrt(coalesce(var_samp(Speed_kmh) OVER {_TRAILING}, 0e0))', 'Speed_Deviation', 6)},
  {r(f'greatest(max(Acceleration_mps2) OVER {_TRAILING}, 0e0)', 'Max_Acceleration_mps2', 6)}, {r(f'greatest(max(-Acceleration_mps2) OVER {_TRAILING}, 0e0)', 'Max_Deceleration_mps2', 6)} FROM history""", 6)
def _(v):
    # The root of the variance: a variance of few quarter steps ends in a 5 that rounds either way.
    rows = drivers.trailing_extremes(v.history, "event_id")
    return rows.withColumn("Speed_Deviation", F.sqrt("Speed_Variance")).drop("Speed_Variance")


@query("C24_preprocess_with_history", f"""WITH l AS (SELECT h.*, max(Last_Update) OVER (PARTITION BY Plate) AS newest FROM history h),
  w AS (SELECT Plate, avg(CASE WHEN Last_Update >= newest - INTERVAL 7 DAY THEN Speed_kmh END) AS mean7, sum(Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count) AS harsh30,
    max(Speed_kmh) AS top, coalesce(var_samp(Speed_kmh), 0e0) AS spread, greatest(max(Acceleration_mps2), 0e0) AS up, greatest(max(-Acceleration_mps2), 0e0) AS down
    FROM l WHERE Last_Update >= newest - INTERVAL 30 DAY GROUP BY Plate)
  SELECT p.Plate, {r('coalesce(mean7, p.Avg_Speed_Last_7_Days)', 'Avg_Speed_Last_7_Days', 8)}, {r('coalesce(harsh30, p.Total_Harsh_Events_Last_30_Days)', 'Total_Harsh_Events_Last_30_Days', 8)},
  {r('coalesce(top, coalesce(p.Speed_kmh, 0e0))', 'Max_Speed_kmh', 8)}, {r('sqrt(coalesce(spread, 0e0))', 'Speed_Deviation', 8)}, {r('coalesce(up, least(abs(coalesce(p.Acceleration_mps2, 0e0)), 6e0))', 'Max_Acceleration_mps2', 8)},
  {r('coalesce(down, least(abs(coalesce(p.Acceleration_mps2, 0e0)) * 6e-1, 6e0))', 'Max_Deceleration_mps2', 8)}, {r('p.Fatigue_Risk_Score', 'Fatigue_Risk_Score', 8)} FROM prepared p LEFT JOIN w ON w.Plate = p.Plate""", 8)
def _(v):
    return features.preprocess(v.portfolio, AS_OF, plates_known=True, history=v.history).select(
        "Plate", "Avg_Speed_Last_7_Days", "Total_Harsh_Events_Last_30_Days", "Max_Speed_kmh", F.sqrt("Speed_Variance").alias("Speed_Deviation"), "Max_Acceleration_mps2",
        "Max_Deceleration_mps2", "Fatigue_Risk_Score")


@query("W5_vehicle_extremes", f"""SELECT Plate, {r('max(Speed_kmh)', 'Max_Speed_kmh', 3)}, {r('coalesce(var_samp(Speed_kmh), 0e0)', 'Speed_Variance', 3)},
  {r('greatest(max(Acceleration_mps2), 0e0)', 'Max_Acceleration_mps2', 3)}, {r('greatest(max(-Acceleration_mps2), 0e0)', 'Max_Deceleration_mps2', 3)} FROM history GROUP BY Plate""", 3)
def _(v):
    return drivers.vehicle_extremes(v.history)


@query("W6_vehicle_share", f"SELECT City, count(DISTINCT Plate) AS Vehicle_Count, {r('count(DISTINCT Plate) * 1e0 / (SELECT count(DISTINCT Plate) FROM portfolio) * 1e2', 'Vehicle_Share_Pct')} FROM portfolio GROUP BY City")
def _(v):
    return rollups.vehicle_share(v.portfolio)


@query("W7_trip_sessions", f"""WITH p AS (SELECT Plate, Last_Update, event_id, Status, Speed_kmh, lag(Status) OVER w AS ps, epoch_us(Last_Update) / 1e6 - lag(epoch_us(Last_Update)) OVER w / 1e6 AS gap FROM history
  WINDOW w AS (PARTITION BY Plate ORDER BY Last_Update, event_id)),
  s AS (SELECT p.*, sum(CASE WHEN Status = 'Driving' AND (ps IS NULL OR ps <> 'Driving') THEN 1 ELSE 0 END) OVER (PARTITION BY Plate ORDER BY Last_Update, event_id) AS trip,
  CASE WHEN Status = 'Driving' AND ps = 'Driving' THEN gap / 3600e0 ELSE 0e0 END AS hours FROM p)
  SELECT Plate, CAST(trip AS BIGINT) AS trip_number, min(Last_Update) AS trip_start, max(Last_Update) AS trip_end, count(*) AS observations,
  {r('sum(hours)', 'trip_hours', 3)}, {r('sum(Speed_kmh * hours)', 'trip_distance_km', 2)} FROM s WHERE Status = 'Driving' GROUP BY Plate, trip""", 3)
def _(v):
    from catalog.registry import settled
    return settled(drivers.trip_sessions(v.history, tiebreak=["event_id"]), {"trip_hours": 3, "trip_distance_km": 2})


# --- sorts and top lists ---------------------------------------------------------------
@query("L1_fastest_vehicles", f"""SELECT Plate, {r('Speed_kmh')}, Status, Road_Type, City, CAST(row_number() OVER (ORDER BY Speed_kmh DESC, Plate) AS INT) AS Leaderboard_Position
  FROM portfolio WHERE Speed_kmh IS NOT NULL ORDER BY Speed_kmh DESC, Plate LIMIT 10""")
def _(v):
    return filters.fastest_vehicles(v.portfolio)


@query("L2_recommendations", f"""SELECT Plate, City, Type, {r('Speed_kmh')}, b2 AS Risk_Band, {r('s2', 'Calculated_Risk_Score')}, {r('Expected_Claim')},
  {S.case_map('b2', K.BAND_REVIEW_ACTION, 'Monitor')} AS Risk_Action, {', '.join(r(c) for c in K.RECOMMENDATION_COLUMNS[8:])}
  FROM ({_RESCORE}) ORDER BY s2 DESC, Plate LIMIT 20""")
def _(v):
    return rollups.recommendations(v.priced)


@query("L3_top_cities", f"SELECT * FROM ({_CITY_TABLE}) ORDER BY Total_Profit DESC, City LIMIT 10", 5)
def _(v):
    return filters.top_rows(rollups.city_analytics(v.priced), "Total_Profit", 10, key="City")


@query("L4_multi_sort", f"SELECT Plate, City, {r('Base_Price_USD')} FROM portfolio")
def _(v):
    return filters.multi_sort(v.portfolio.select("Plate", "City", "Base_Price_USD"), ["Base_Price_USD", "City"], "Plate")


@query("L5_prediction_table", f"""SELECT Plate, Type, City, {r('City_Risk_Score')}, {r('Speed_kmh')}, {r('Recent_Harsh_Events')}, Road_Type, Weather, Time_of_Day,
  {r('Calculated_Risk_Score')}, Risk_Band, {r('Expected_Claim')} FROM live ORDER BY Plate LIMIT 100""")
def _(v):
    return filters.prediction_table(v.prepared)


@query("Q2_live_ready", f"""SELECT Plate, Risk_Band, {r('Calculated_Risk_Score')}, {r('Monthly_Premium_USD', None, 2)}, {r('Underwriting_Profit_USD', None, 2)} FROM priced""")
def _(v):
    from catalog.registry import settled
    from fleetrisk.plans.portfolio import live_ready
    base = features.preprocess(v.portfolio.select("Plate", "Type", "Usage", "City", "Year", "Engine_CC", "Base_Price_USD", "Make", "Model",
                                                  "GPS_Latitude", "GPS_Longitude"), AS_OF, plates_known=True)
    out = live_ready(base, v.prepared.drop("Throttle_pct"), ["Last_Update"])
    return settled(out.select("Plate", "Risk_Band", "Calculated_Risk_Score", "Monthly_Premium_USD", "Underwriting_Profit_USD"),
                   {"Monthly_Premium_USD": 2, "Underwriting_Profit_USD": 2})




@query("Q1_portfolio_bundle", f"""SELECT Plate, Risk_Band, Status, {r('LightGBM_Risk_Score')}, {r('Calculated_Risk_Score')}, {r('Monthly_Premium_USD', None, 2)},
  {r('Expected_Claim_USD', None, 2)}, {r('Underwriting_Profit_USD', None, 2)}, 'portfolio' AS Analysis_Source FROM u_priced""")
def _(v):
    from catalog.registry import settled
    from fleetrisk.plans.portfolio import analyse_portfolio
    bundle = analyse_portfolio(v.portfolio, AS_OF, persist=False, plates_known=True)
    money = ("Monthly_Premium_USD", "Expected_Claim_USD", "Underwriting_Profit_USD")
    out = bundle["analysis"].select("Plate", "Risk_Band", "Status", "LightGBM_Risk_Score", "Calculated_Risk_Score", *money, "Analysis_Source")
    return settled(out, dict.fromkeys(money, 2))
