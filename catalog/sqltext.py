"""SQL text of the shared views, for the twin of each registered query."""

from __future__ import annotations

from fleetrisk import constants as K
from fleetrisk.sources.testdata import HISTORY, PORTFOLIO, TELEMETRY

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def lit(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value) + "e0" if isinstance(value, float) and "e" not in repr(value) else repr(value)


def case_map(expr: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    rest = "NULL" if default is None else lit(default)
    return f"(CASE {expr} {whens} ELSE {rest} END)"


def bins(expr: str, table) -> str:
    whens = " ".join(f"WHEN {expr} >= {lit(float(e))} THEN {lit(float(r))}" for e, r in reversed(table))
    return f"(CASE {whens} ELSE 0e0 END)"


def clip(expr: str, low: float, high: float | None = None) -> str:
    inner = f"greatest({expr}, {lit(float(low))})"
    return inner if high is None else f"least({inner}, {lit(float(high))})"


def rounded(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def band(expr: str) -> str:
    return (f"(CASE WHEN {expr} >= 0.81e0 THEN 'Critical' WHEN {expr} >= 0.51e0 THEN 'High' "
            f"WHEN {expr} >= 0.31e0 OR {expr} IS NULL THEN 'Medium' ELSE 'Low' END)")


def time_of_day(ts: str) -> str:
    return (f"(CASE WHEN hour({ts}) >= 22 OR hour({ts}) < 2 THEN 'Late Night' WHEN hour({ts}) < 5 THEN 'Dawn' "
            f"WHEN hour({ts}) < 10 THEN 'Morning Rush' WHEN hour({ts}) < 17 THEN 'Mid-Day' "
            f"WHEN hour({ts}) < 20 THEN 'Evening Rush' WHEN {ts} IS NULL THEN NULL ELSE 'Night' END)")


def _columns(pairs) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in pairs)


_NIGHT = "('Night', 'Late Night', 'Dawn')"
_ABSENT = ("Type", "Usage", "Make", "Model")


def _one_hot(road: str) -> str:
    return f"CASE WHEN Road_Type = '{road}' THEN 1e0 ELSE 0e0 END AS {road}_Ratio"


def _prepared(out: str, source: str) -> dict[str, str]:
    """Preprocessed snapshot: features from raw values, then defaults."""
    acc = "least(greatest(abs(coalesce(Acceleration_mps2, 0e0)) / 6e0, 0e0), 1e0)"
    first = f"""
SELECT s.*,
  CASE WHEN Time_of_Day IN {_NIGHT} THEN 1 ELSE 0 END AS Night_Driving_Flag,
  greatest(2026e0 - coalesce(Year, 2026), 0e0) AS Vehicle_Age_Years,
  {_one_hot('Potholed')}, {_one_hot('Gravel')}, {_one_hot('Highway')}, {_one_hot('Urban')},
  {case_map('Road_Type', K.ROAD_MAX_SPEED, 80.0)} AS Base_Road_Max_Speed_kmh,
  least(coalesce(Harsh_Brake_Count, 0) + coalesce(Harsh_Accel_Count, 0) + coalesce(Harsh_Corner_Count, 0), 10)
    * 1e0 AS Recent_Harsh_Events,
  {clip('coalesce(Speed_kmh, 0e0) * 0.95e0', 0.0, 180.0)} AS Recent_Avg_Speed,
  CASE WHEN Trip_Distance_km > 0 THEN coalesce(Speeding_Flag, 0) / (Trip_Distance_km / 1e2) ELSE 0e0 END
    AS Recent_Speeding_Ratio,
  {clip('(coalesce(Battery_V, 12.6e0) - 11.5e0) * 5e1', 0.0, 100.0)} AS Battery_Health_Score,
  {case_map('Weather', K.WEATHER_FACTOR, 1.0)} AS Weather_Risk_Score,
  CASE WHEN coalesce(Coolant_Temp_C, 0e0) > 95 THEN 1 ELSE 0 END AS Coolant_Overheat_Flag,
  coalesce(Last_Update, {AS_OF}) AS seen_at
FROM {source} s"""
    second = f"""
SELECT s.*,
  greatest(coalesce(Speed_kmh, 0e0) - Base_Road_Max_Speed_kmh, 0e0) AS Speeding_Excess_kmh,
  coalesce(Trip_Distance_km, 0e0) * CASE WHEN Night_Driving_Flag = 1 THEN 0.45e0 ELSE 0.08e0 END
    AS Recent_Night_Distance,
  Recent_Avg_Speed AS Avg_Speed_Last_7_Days,
  {rounded('Recent_Harsh_Events * 3e1', 1)} AS Total_Harsh_Events_Last_30_Days,
  {clip('0.25e0 * (Recent_Harsh_Events / 5e0) + 0.25e0 * coalesce(Speeding_Flag, 0)', 0.0, 1.0)}
    AS Driving_Event_Score,
  {clip(f'0.35e0 * (Recent_Harsh_Events / 5e0) + 0.35e0 * coalesce(Speeding_Flag, 0) + 0.30e0 * {acc}', 0.0, 1.0)}
    AS Aggressive_Driving_Score,
  {clip("0.4e0 * Night_Driving_Flag + 0.2e0 * least(coalesce(Trip_Duration_Hour, 0e0) / 5e0, 1e0)"
        " + 0.2e0 * CASE WHEN Day_of_Week IN ('Saturday', 'Sunday') THEN 1e0 ELSE 0e0 END", 0.0, 1.0)}
    AS Fatigue_Risk_Score
FROM {out}_1 s"""
    third = f"""
SELECT s.* REPLACE (
    coalesce(Type, 'Sedan') AS Type, coalesce(Usage, 'Private') AS Usage, coalesce(Make, 'Unknown') AS Make,
    coalesce(Model, 'Unknown') AS Model, coalesce(City, 'Harare') AS City,
    coalesce(Road_Type, 'Urban') AS Road_Type, coalesce(Weather, 'Sunny') AS Weather,
    coalesce(Status, 'Parked') AS Status, coalesce(Year, 2024) AS Year,
    coalesce(Engine_CC, 1500) AS Engine_CC, coalesce(Base_Price_USD, 600e0) AS Base_Price_USD,
    coalesce(Trip_Distance_km, 0e0) AS Trip_Distance_km, coalesce(Trip_Duration_Hour, 0e0) AS Trip_Duration_Hour,
    coalesce(Speed_kmh, 0e0) AS Speed_kmh, coalesce(Acceleration_mps2, 0e0) AS Acceleration_mps2,
    coalesce(RPM, 700e0) AS RPM, coalesce(Engine_Load_pct, 5e0) AS Engine_Load_pct,
    coalesce(Coolant_Temp_C, 75e0) AS Coolant_Temp_C, coalesce(MAF_gs, 1e0) AS MAF_gs,
    coalesce(Battery_V, 12.6e0) AS Battery_V, coalesce(Harsh_Brake_Count, 0) AS Harsh_Brake_Count,
    coalesce(Harsh_Accel_Count, 0) AS Harsh_Accel_Count, coalesce(Harsh_Corner_Count, 0) AS Harsh_Corner_Count,
    coalesce(Speeding_Flag, 0) AS Speeding_Flag, seen_at AS Last_Update,
    coalesce(Time_of_Day, 'Late Night') AS Time_of_Day, coalesce(Day_of_Week, 'Thursday') AS Day_of_Week),
  coalesce(Harsh_Brake_Count, 0) + coalesce(Harsh_Accel_Count, 0) + coalesce(Harsh_Corner_Count, 0)
    AS Total_Harsh_Events_per_Day,
  8.5e0 AS Fuel_Efficiency_L_per_100km, 'Unknown' AS Class, 0e0 AS Throttle_pct,
  CASE WHEN Base_Road_Max_Speed_kmh > 0
       THEN {clip('Speeding_Excess_kmh / Base_Road_Max_Speed_kmh', 0.0, 1.0)} ELSE 0e0 END * Night_Driving_Flag
    AS Speeding_Ratio_x_Night_Driving_Ratio,
  'IDLE-' || Plate || '-000000' AS Trip_ID,
  year(seen_at) AS Update_Year, month(seen_at) AS Update_Month, day(seen_at) AS Update_Day,
  hour(seen_at) AS Update_Hour, minute(seen_at) AS Update_Minute
FROM {out}_2 s"""
    return {f"{out}_1": first, f"{out}_2": second, out: third}


def _live(out: str, source: str) -> dict[str, str]:
    """Risk components and live outputs over a preprocessed snapshot without prior scores."""
    hours = "CASE WHEN Trip_Duration_Hour = 0 THEN 0.1e0 ELSE Trip_Duration_Hour END"
    features = f"""
SELECT s.*,
  greatest(coalesce(Speed_kmh / nullif(Base_Road_Max_Speed_kmh, 0e0), 0e0), 0e0) AS Speed_to_Road_Limit_Ratio,
  Harsh_Corner_Count + Harsh_Accel_Count + Harsh_Brake_Count AS Harsh_Events_Per_Day,
  {case_map('Road_Type', K.ROAD_RISK, 0.40)} AS Road_Type_Risk_Score,
  {case_map('Time_of_Day', K.TIME_RISK, 0.30)} AS Time_of_Day_Risk_Score,
  {case_map('Day_of_Week', K.DAY_RISK, 0.30)} AS Day_of_Week_Risk_Score,
  Trip_Distance_km * 22e0 AS Total_Distance_Monthly_km,
  {case_map('City', K.CITY_RISK, 0.15)} AS City_Risk_Score,
  Recent_Harsh_Events / ({hours}) AS per_hour,
  Engine_Load_pct / 1e2 * (RPM / 7e3) * 1e2 AS stress,
  {clip('CASE WHEN Weather_Risk_Score BETWEEN 0 AND 1 THEN Weather_Risk_Score ELSE Weather_Risk_Score / 1.3e0 END',
        0.0, 1.0)} AS Weather_Risk
FROM {source} s"""
    components = f"""
SELECT s.*,
  0.6e0 * {bins('Speed_to_Road_Limit_Ratio', K.SPEED_RATIO_BINS)}
    + 0.4e0 * {bins('Speeding_Excess_kmh', K.SPEED_EXCESS_BINS)} AS Speeding_Risk,
  0.4e0 * {bins('per_hour', K.HARSH_PER_HOUR_BINS)} + 0.3e0 * 0.10e0
    + 0.3e0 * {bins('Recent_Harsh_Events', K.HARSH_COUNT_BINS)} AS Harsh_Risk,
  0.5e0 * {bins('Coolant_Temp_C', K.COOLANT_BINS)} + 0.25e0 * {bins('Battery_V', K.BATTERY_BINS)}
    + 0.25e0 * {bins('stress', K.ENGINE_STRESS_BINS)} AS Engine_Risk,
  {clip('Fatigue_Risk_Score', 0.0, 1.0)} AS Fatigue_Risk,
  least(Trip_Distance_km / 1e2, 1e0) AS Exposure_Risk,
  0.5e0 * Road_Type_Risk_Score + 0.5e0 * Time_of_Day_Risk_Score AS Environment_Risk,
  {clip('0.20e0 * Weather_Risk + 0.30e0 * Road_Type_Risk_Score + 0.20e0 * Time_of_Day_Risk_Score'
        ' + 0.10e0 * Day_of_Week_Risk_Score + 0.20e0 * City_Risk_Score', 0.0, 1.0)} AS Environmental_Risk,
  least(Vehicle_Age_Years / 2e1, 1e0) * 0.5e0
    + greatest((Fuel_Efficiency_L_per_100km - 5e0) / 1e1, 0e0) * 0.3e0 AS Vehicle_Condition_Risk,
  0.4e0 * CASE WHEN Night_Driving_Flag <> 0 THEN 0.6e0 ELSE 0.2e0 END + 0.3e0 * 0.25e0 + 0.3e0 * 0.3e0
    AS Behavioral_Risk
FROM {out}_features s"""
    overall = f"""
SELECT s.*,
  {clip('0.30e0 * Speeding_Risk + 0.25e0 * Harsh_Risk + 0.15e0 * Fatigue_Risk + 0.10e0 * Weather_Risk'
        ' + 0.10e0 * Exposure_Risk + 0.10e0 * Environment_Risk', 0.0, 1.0)} AS Overall_Risk
FROM {out}_components s"""
    scored = f"""
SELECT s.*, least(greatest({surcharged('Overall_Risk')}, 0e0), 1e0) AS Calculated_Risk_Score
FROM {out}_overall s"""
    final = f"""
SELECT s.*, Calculated_Risk_Score AS Risk_Score, Calculated_Risk_Score AS LightGBM_Risk_Score,
  Calculated_Risk_Score AS Custom_Risk_Score,
  {band('Calculated_Risk_Score')} AS Risk_Band,
  {case_map(band('Calculated_Risk_Score'), K.BAND_EXPECTED_CLAIM, 2200.0)} AS Expected_Claim,
  {case_map(band('Calculated_Risk_Score'), K.BAND_REVIEW_ACTION, 'Monitor')} AS Risk_Action
FROM {out}_scored s"""
    return {f"{out}_features": features, f"{out}_components": components, f"{out}_overall": overall,
            f"{out}_scored": scored, out: final}


def surcharged(score: str) -> str:
    public = "Type IN ('Kombi', 'Minibus', 'Bus')"
    commercial = "(lower(Usage) = 'commercial' OR Type IN ('Pickup', 'Van', 'Light Truck', 'Heavy Truck'))"
    return (f"{score} + CASE WHEN {commercial} THEN 0.015e0 ELSE 0e0 END"
            f" + CASE WHEN {public} THEN 0.025e0 ELSE 0e0 END"
            f" + CASE WHEN {public} AND Vehicle_Age_Years >= 12 THEN 0.010e0 ELSE 0e0 END")


def _priced(out: str, source: str) -> dict[str, str]:
    base = case_map("Type", K.BASE_PREMIUM, K.BASE_PREMIUM_DEFAULT)
    service = "(Usage = 'Commercial' OR Type IN ('Kombi', 'Minibus', 'Pickup', 'Heavy Truck'))"
    load = "(0.62e0 + Calculated_Risk_Score * 1.33e0)"
    first = f"""
SELECT s.* EXCLUDE (Expected_Claim),
  {clip(f'{base} * {load} / 12e0 / 30e0', 1.0, 13.33)} AS Daily_Premium_USD,
  {clip(f'{base} * {load} / 12e0', 30.0, 400.0)} AS Monthly_Premium_USD,
  Base_Price_USD * {clip('0.01e0 + Calculated_Risk_Score * 0.44e0', 0.01, 0.45)} * 0.10e0 / 12e0
    AS Expected_Claim_USD,
  {case_map('Risk_Band', K.ACTION_CODE, 0)} AS Recommended_Action,
  {case_map('Risk_Band', K.ACTION_CONTROL_COST, 0.0)} AS control_cost,
  CASE WHEN {service} THEN 0.5e0 ELSE 0.25e0 END AS admin_cost,
  CASE WHEN {service} THEN 0.16e0 ELSE 0.12e0 END + {case_map('Risk_Band', K.BAND_EXPENSE_LOADING, 0.0)} AS ratio
FROM {source} s"""
    second = f"""
SELECT s.*, Expected_Claim_USD AS Expected_Claim,
  Monthly_Premium_USD * ratio AS variable_cost,
  Monthly_Premium_USD * ratio + control_cost + admin_cost AS total_cost
FROM {out}_1 s"""
    third = f"""
SELECT s.*,
  {rounded('variable_cost', 2)} AS Variable_Expenses_USD, {rounded('control_cost', 2)} AS Control_Cost_USD,
  {rounded('total_cost', 2)} AS Underwriting_Expenses_USD,
  {rounded('greatest(Monthly_Premium_USD - Expected_Claim_USD - total_cost, 0e0)', 2)} AS Underwriting_Profit_USD
FROM {out}_2 s"""
    zig = ", ".join(f"{rounded(f'{c}_USD * 26.5e0', 2)} AS {c}_ZIG" for c in (
        "Base_Price", "Daily_Premium", "Monthly_Premium", "Expected_Claim", "Variable_Expenses", "Control_Cost",
        "Underwriting_Expenses", "Underwriting_Profit"))
    action = case_map("Risk_Band", K.BAND_POLICY_ACTION, "standard_offer")
    final = f"""
SELECT s.*, {zig}, {action} AS PPO_Action, {case_map(action, K.POLICY_MULTIPLIER, 1.0)} AS Premium_Multiplier
FROM {out}_3 s"""
    return {f"{out}_1": first, f"{out}_2": second, f"{out}_3": third, out: final}


def _imputed(out: str, source: str) -> dict[str, str]:
    """Fraud report telemetry of a scored frame."""
    driving = "lower(Status) = 'driving'"
    first = f"""
SELECT s.* REPLACE (
    {clip('Speed_kmh', 0.0, 300.0)} AS Speed_kmh,
    {clip('Aggressive_Driving_Score', 0.0, 1.0)} AS Aggressive_Driving_Score,
    greatest(Total_Distance_Monthly_km, 0e0) AS Total_Distance_Monthly_km,
    {clip('RPM', 0.0, 7000.0)} AS RPM, {clip('Engine_Load_pct', 0.0, 100.0)} AS Engine_Load_pct,
    greatest(MAF_gs, 0e0) AS MAF_gs,
    greatest({clip('Speed_kmh', 0.0, 300.0)} - 5e1, 0e0) AS Speeding_Excess_kmh)
FROM {source} s"""
    flags = f"""
SELECT s.*, CASE WHEN {driving} THEN Speed_kmh > 250 OR Speeding_Excess_kmh > 50 OR Speed_kmh > 120
                 ELSE Speeding_Flag = 1 END AS speeding_now
FROM {out}_1 s"""
    columns = ("Risk_Score", "Speeding_Excess_kmh", "Aggressive_Driving_Score", "Total_Distance_Monthly_km")
    med = ", ".join(f"median({c}) AS m{i}, avg({c}) AS a{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(columns))
    mad = ", ".join(f"median(abs({c} - m{i})) AS d{i}" for i, c in enumerate(columns))
    zs = " + ".join(
        f"abs(CASE WHEN d{i} > 0 THEN ({c} - m{i}) / (1.4826e0 * d{i}) WHEN s{i} > 0 THEN ({c} - a{i}) / s{i} "
        "ELSE 0e0 END)" for i, c in enumerate(columns))
    raw = f"SELECT s.*, ({zs}) / 4e0 AS raw FROM {out}_2 s, {out}_med, {out}_mad"
    layers = f"""
SELECT s.*, speeding_now OR Speed_kmh > 250 OR Speeding_Excess_kmh > 50 AS Rule_Violation_Flag,
  {clip('raw / cap', 0.0, 1.0)} AS Anomaly_Score,
  {clip('Risk_Score', 0.0, 1.0)} AS Fraud_Probability,
  {clip('1e0 - least(1e0, abs(MAF_gs - (5e0 + Engine_Load_pct / 1e2 * 12e1 + RPM / 7e3 * 3e1))'
        ' / greatest(5e0 + Engine_Load_pct / 1e2 * 12e1 + RPM / 7e3 * 3e1, 1e0))', 0.0, 1.0)}
    AS Data_Consistency_Score
FROM {out}_raw s,
  (SELECT CASE WHEN quantile_cont(raw, 0.95) > 0 THEN quantile_cont(raw, 0.95) ELSE 1e0 END AS cap FROM {out}_raw) c"""
    tests = f"""
SELECT s.*, Anomaly_Score > 0.6e0 AS Is_Anomaly, Fraud_Probability > 0.7e0 AS Fraud_Risk_Flag,
  Data_Consistency_Score < 0.6e0 AS Tampering_Suspected
FROM {out}_layers s"""
    count = " + ".join(f"CAST({f} AS INT)" for f in (
        "Rule_Violation_Flag", "Is_Anomaly", "Fraud_Risk_Flag", "Tampering_Suspected"))
    final = f"""
SELECT s.*, Rule_Violation_Flag OR Is_Anomaly OR Fraud_Risk_Flag OR Tampering_Suspected AS Overall_Fraud_Flag,
  {clip(f'0.6e0 * Fraud_Probability + 0.25e0 * (({count}) / 4e0) + 0.15e0 * Anomaly_Score', 0.0, 1.0)}
    AS Composite_Score
FROM {out}_tests s"""
    last = f"""
SELECT s.*, CASE WHEN Composite_Score >= 0.85e0 THEN 'Critical' WHEN Composite_Score >= 0.70e0 THEN 'High'
                 WHEN Composite_Score >= 0.45e0 THEN 'Medium' ELSE 'Low' END AS Candidate_Severity
FROM {out}_composite s"""
    return {f"{out}_1": first, f"{out}_2": flags, f"{out}_med": f"SELECT {med} FROM {out}_2",
            f"{out}_mad": f"SELECT {mad} FROM {out}_2, {out}_med", f"{out}_raw": raw, f"{out}_layers": layers,
            f"{out}_tests": tests, f"{out}_composite": final, out: last}


def _views() -> dict[str, str]:
    views = {}
    views["history"] = (f"SELECT h.*, {time_of_day('Last_Update')} AS Time_of_Day, "
                        f"dayname(Last_Update) AS Day_of_Week FROM (SELECT {_columns(HISTORY)} FROM events) h")
    views["latest"] = ("SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY Plate ORDER BY Last_Update DESC, "
                       "event_id DESC) AS rn FROM history h) WHERE rn = 1")
    views["portfolio"] = (f"SELECT f.*, {', '.join('l.' + c for c in TELEMETRY)} FROM "
                          f"(SELECT {_columns(PORTFOLIO)} FROM customer) f LEFT JOIN latest l ON f.Plate = l.Plate")
    nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _ABSENT)
    views["h_full"] = (f"SELECT h.*, {nulls}, CAST(NULL AS INT) AS Year, CAST(NULL AS INT) AS Engine_CC, "
                       "CAST(NULL AS DOUBLE) AS Base_Price_USD FROM history h")
    views.update(_prepared("h_prepared", "h_full"))
    views.update(_live("h_live", "h_prepared"))
    views.update(_priced("h_priced", "h_live"))
    views.update(_prepared("prepared", "portfolio"))
    views.update(_live("live", "prepared"))
    views.update(_priced("priced", "live"))
    views.update(_imputed("assessed", "priced"))
    # An uploaded portfolio has no engineered columns, so most components take their defaults.
    views["u_scored"] = f"""
SELECT p.* REPLACE (coalesce(Status, 'Driving') AS Status), 0e0 AS Vehicle_Age_Years, 0.0675e0 AS LightGBM_Risk_Score,
  0.30e0 * 0.04e0 + 0.25e0 * 0.085e0 + 0.10e0 * {case_map('Weather', K.WEATHER_RISK, 0.30)}
    + 0.10e0 * least(coalesce(Trip_Distance_km, 0e0) / 1e2, 1e0)
    + 0.10e0 * (0.5e0 * {case_map('Road_Type', K.ROAD_RISK, 0.40)} + 0.5e0 * {case_map('Time_of_Day', K.TIME_RISK, 0.30)})
    AS Overall_Risk FROM portfolio p"""
    views["u_live"] = f"""
SELECT q.*, {band('Calculated_Risk_Score')} AS Risk_Band, 0e0 AS Expected_Claim FROM (
  SELECT s.*, {surcharged('Overall_Risk')} AS Calculated_Risk_Score FROM u_scored s) q"""
    views.update(_priced("u_priced", "u_live"))
    return views


VIEWS = _views()


def _uses(sql: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![\w.]){name}(?!\w)", sql) is not None


def with_views(body: str) -> str:
    """The body with exactly the views it needs in front."""
    needed: list[str] = []
    text = body
    for name in reversed(VIEWS):
        if _uses(text, name):
            needed.insert(0, name)
            text += "\n" + VIEWS[name]
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {views},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"
