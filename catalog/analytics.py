"""Fraud layers, statistics and the risk model."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import AS_OF, query, r, settled
from fleetrisk import constants as K
from fleetrisk.operators import fraud, modeling, ranks, rollups, statistics
from fleetrisk.functions.runtime import settle, shared_folder

# --- fraud ------------------------------------------------------------------------
_RULES = ("(Speed_kmh > 180 OR abs(coalesce(Acceleration_mps2, 0e0)) > 7 OR coalesce(Battery_V, 12.6e0) < 10.5e0 "
          "OR coalesce(Battery_V, 12.6e0) > 15e0)")


@query("A1_fraud_flags", f"SELECT event_id, CASE WHEN {_RULES} THEN 1 ELSE 0 END AS Fraud_Flag FROM history")
def _(v):
    return fraud.fraud_flags(v.history).select("event_id", "Fraud_Flag")


@query("A1_fleet_spread", f"""SELECT Plate, CASE WHEN {_RULES} OR (SELECT (max(GPS_Latitude) - min(GPS_Latitude)) * 111 > 500
  OR (max(GPS_Longitude) - min(GPS_Longitude)) * 111 > 500 FROM portfolio) THEN 1 ELSE 0 END AS Fraud_Flag FROM portfolio""")
def _(v):
    return fraud.fraud_flags(v.portfolio).select("Plate", "Fraud_Flag")


@query("A2_fraud_table", f"""SELECT Plate, {r('Speed_kmh')}, {r('Acceleration_mps2')}, {r('Battery_V')}, {r('Trip_Distance_km')},
  CASE WHEN Speed_kmh > 180 OR abs(Acceleration_mps2) > 7 THEN 'Critical' ELSE 'Medium' END AS Severity FROM history WHERE {_RULES}""")
def _(v):
    return fraud.fraud_table(v.history)


def _ready(v):
    return fraud.impute_driving_telemetry(v.priced)


@query("A3_rule_layer", """SELECT Plate, Rule_Violation_Flag, CASE WHEN NOT Rule_Violation_Flag THEN 'None' WHEN Speed_kmh > 250 THEN 'Speed exceeds 250 km/h'
  WHEN Speeding_Excess_kmh > 50 THEN 'Speed exceeds road limit by >50 km/h' ELSE 'None' END AS Rule_Violation_Reason FROM assessed""")
def _(v):
    return fraud.rule_layer(_ready(v)).select("Plate", "Rule_Violation_Flag", "Rule_Violation_Reason")


_Z = "CASE WHEN d{i} > 0 THEN ({c} - m{i}) / (1.4826e0 * d{i}) WHEN s{i} > 0 THEN ({c} - a{i}) / s{i} ELSE 0e0 END"


@query("A4_robust_z", "SELECT Plate, " + ", ".join(r(_Z.format(i=i, c=c), f"z_{c}") for i, c in enumerate(fraud.ANOMALY_COLUMNS))
       + " FROM assessed_2, assessed_med, assessed_mad")
def _(v):
    return fraud.robust_z(settle(_ready(v))).select("Plate", *[f"z_{c}" for c in fraud.ANOMALY_COLUMNS])


@query("A5_anomaly_score", f"SELECT Plate, {r('Anomaly_Score')}, Is_Anomaly FROM assessed")
def _(v):
    return fraud.anomaly_layer(settle(_ready(v))).select("Plate", "Anomaly_Score", "Is_Anomaly")


@query("A6_fraud_probability", f"SELECT Plate, {r('Fraud_Probability')}, Fraud_Risk_Flag FROM assessed")
def _(v):
    return fraud.probability_layer(v.priced).select("Plate", "Fraud_Probability", "Fraud_Risk_Flag")


@query("A7_consistency", f"SELECT Plate, {r('Data_Consistency_Score')}, Tampering_Suspected FROM assessed")
def _(v):
    return fraud.consistency_layer(_ready(v)).select("Plate", "Data_Consistency_Score", "Tampering_Suspected")


@query("A8_composite", f"SELECT Plate, {r('Composite_Score')}, Candidate_Severity, Overall_Fraud_Flag FROM assessed")
def _(v):
    return fraud.assessed_vehicles(v.priced, AS_OF).select("Plate", "Composite_Score", "Candidate_Severity", "Overall_Fraud_Flag")


def _state(v):
    """A stored severity of the vehicles that have a history, as of their last observation."""
    level = F.element_at(F.array(*[F.lit(b) for b in K.BANDS]), (F.pmod(F.max("event_id"), F.lit(4)) + 1).cast("int"))
    return v.history.groupBy(F.col("Plate").alias("plate")).agg(
        level.alias("severity"), F.max("Last_Update").alias("last_updated"), F.max("Speed_kmh").alias("composite_score"))


_STICKY = """SELECT a.*, CASE WHEN st.u IS NOT NULL AND epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(st.u) < hours * 3600e0 * 1e6 THEN st.severity
  ELSE Candidate_Severity END AS Severity FROM assessed a LEFT JOIN (SELECT s.*, CASE severity WHEN 'Critical' THEN 72 WHEN 'High' THEN 48 WHEN 'Medium' THEN 24 ELSE 12 END AS hours FROM
  (SELECT Plate, CASE max(event_id) % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity, max(Last_Update) AS u
   FROM history GROUP BY Plate) s) st ON a.Plate = st.Plate"""


@query("A9_sticky_severity", f"SELECT Plate, Candidate_Severity, Severity FROM ({_STICKY})")
def _(v):
    return fraud.assessed_vehicles(v.priced, AS_OF, _state(v)).select("Plate", "Candidate_Severity", "Severity")


_ROUND = "CASE {} % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END"


@query("A9_state_rounds", f"""WITH c AS (SELECT Plate AS plate, c_custkey % 5 <> 0 AS seen, {_ROUND.format('(c_custkey * 7 // 3)')} AS one, {_ROUND.format('c_custkey')} AS two,
    c_custkey % 100 / 1e2 AS score_1, c_custkey % 77 / 1e2 AS score_2 FROM portfolio),
  h AS (SELECT c.*, NOT seen OR one IN ('Critical', 'High') AS held FROM c)
  SELECT plate, CASE WHEN held THEN one ELSE two END AS severity, CASE WHEN held THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-02-02 06:00:00' END AS last_updated,
  {r('CASE WHEN held THEN score_1 ELSE score_2 END', 'composite_score')} FROM h""")
def _(v):
    """State, report, next state: a round, and 30 hours later a round over four fifths of the vehicles."""
    from fleetrisk.sources.io import StateTable
    table = StateTable(v.spark, f"{shared_folder(v.spark)}/severity-{uuid.uuid4().hex}")
    level = lambda number: F.expr(_ROUND.format(number))
    first = v.portfolio.select("Plate", level("floor(c_custkey * 7 / 3)").alias("Candidate_Severity"), (F.col("c_custkey") % 100 / 100).alias("Composite_Score"))
    later = v.portfolio.where("c_custkey % 5 <> 0").select("Plate", level("c_custkey").alias("Candidate_Severity"), (F.col("c_custkey") % 77 / 100).alias("Composite_Score"))
    fraud.commit_severities(first, AS_OF, table)
    fraud.commit_severities(later, AS_OF + timedelta(hours=30), table)
    return table.read()


_LAYERS = ("CASE WHEN layers = '' THEN 'None' ELSE layers END AS Detection_Layers_Triggered")
_LABELS = f"""SELECT s.*, {S.case_map('Severity', K.SEVERITY_COLOUR, 'Green')} AS Colour, {S.case_map('Severity', K.SEVERITY_FRAUD_TYPE, '')} AS Fraud_Types_Included,
  {S.case_map('Severity', K.SEVERITY_ACTION, '')} AS Action, concat_ws(',', CASE WHEN Rule_Violation_Flag THEN 'Rule' END, CASE WHEN Is_Anomaly THEN 'Anomaly' END,
  CASE WHEN Fraud_Risk_Flag THEN 'Fraud' END, CASE WHEN Tampering_Suspected THEN 'Consistency' END) AS layers, '2024-02-01 00:00:00' AS Timestamp FROM ({_STICKY}) s"""


@query("A10_labels", f"SELECT Plate, Colour, Fraud_Types_Included, Action, {_LAYERS} FROM ({_LABELS})")
def _(v):
    return fraud.assessed_vehicles(v.priced, AS_OF, _state(v)).select(
        "Plate", "Colour", "Fraud_Types_Included", "Action", "Detection_Layers_Triggered")


_REPORT = ", ".join(r(c) for c in ("Speed_kmh", "Speeding_Excess_kmh", "Aggressive_Driving_Score", "Total_Distance_Monthly_km", "MAF_gs", "RPM",
                                   "Engine_Load_pct", "Risk_Score", "Anomaly_Score", "Fraud_Probability", "Data_Consistency_Score"))


@query("A11_flagged_report", f"SELECT Plate, Model, Type, Status, {_REPORT}, Risk_Band, Fraud_Risk_Flag, Colour, Severity, Fraud_Types_Included, Action, Timestamp, "
       f"{_LAYERS} FROM ({_LABELS}) WHERE Overall_Fraud_Flag")
def _(v):
    return fraud.flagged_report(v.priced, AS_OF, _state(v))


@query("G22_severity_shares", "WITH f AS (SELECT Candidate_Severity AS Severity FROM assessed WHERE Overall_Fraud_Flag) SELECT l.Severity, count(f.Severity) AS Count, "
       + r("count(f.Severity) * 1e0 / (SELECT count(*) FROM f) * 1e2", "Pct")
       + " FROM (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS Severity) l LEFT JOIN f ON l.Severity = f.Severity GROUP BY l.Severity")
def _(v):
    return rollups.severity_shares(fraud.flagged_report(v.priced, AS_OF))


# --- scaling and labels -------------------------------------------------------------
@query("M1_minmax_scale", f"SELECT event_id, {r('(Speed_kmh - (SELECT min(Speed_kmh) FROM history)) / greatest((SELECT max(Speed_kmh) - min(Speed_kmh) FROM history), 1e-6)', 'scaled')} FROM history")
def _(v):
    return statistics.minmax_scale(v.history, "Speed_kmh", "scaled").select("event_id", "scaled")


@query("M2_bounded_scale", f"SELECT event_id, {r('least(Speed_kmh / greatest((SELECT quantile_cont(Speed_kmh, 0.95) FROM history), 1e-6), 1e0)', 'scaled')} FROM history")
def _(v):
    return statistics.bounded_scale(v.history, {"scaled": F.col("Speed_kmh")}).select("event_id", "scaled")


def _cap(column: str) -> str:
    return f"least({column} / greatest((SELECT quantile_cont({column}, 0.95) FROM driving), 1e-6), 1e0)"


_TRAIN = f"""driving AS MATERIALIZED (SELECT d.*, Trip_Duration_Hour + Trip_Distance_km / 4e1 AS trip FROM h_prepared d WHERE upper(Status) = 'DRIVING'),
  raw AS MATERIALIZED (SELECT d.*, 0.28e0 * (Total_Harsh_Events_per_Day / (1e0 + Total_Harsh_Events_per_Day)) + 0.22e0 * {_cap('Speeding_Excess_kmh')} + 0.18e0 * {_cap('Recent_Harsh_Events')}
    + 0.16e0 * {_cap('trip')} + 0.10e0 * {_cap('Engine_Load_pct')} + 0.06e0 * {_cap('Fuel_Efficiency_L_per_100km')} AS raw_risk, {_cap('Engine_Load_pct')} AS load_share FROM driving d),
  scored AS MATERIALIZED (SELECT r.*, least(greatest((raw_risk - (SELECT min(raw_risk) FROM raw)) / greatest((SELECT max(raw_risk) - min(raw_risk) FROM raw), 1e-6), 0e0), 1e0) AS Risk_Score FROM raw r),
  labelled AS MATERIALIZED (SELECT s.*, CASE WHEN Risk_Score >= (SELECT quantile_cont(Risk_Score, 0.65) FROM scored) THEN 1 ELSE 0 END AS Risk_Label,
    {S.rounded('least(greatest(0.02e0 + 0.40e0 * Risk_Score + 0.08e0 * load_share, 0.01e0), 0.95e0)', 4)} AS Claim_Probability,
    RPM / (Speed_kmh + 0.1e0) AS RPM_per_Speed, Engine_Load_pct / (RPM + 0.1e0) AS Load_per_RPM FROM scored s)"""


def _labelled(v):
    return statistics.synthesize_targets(v.h_prepared)


@query("M3_synthesize_targets", f"WITH {_TRAIN} SELECT event_id, {r('Risk_Score')}, Risk_Label, {r('Claim_Probability')}, {r('RPM_per_Speed')}, {r('Load_per_RPM')} FROM labelled")
def _(v):
    return _labelled(v).select("event_id", "Risk_Score", "Risk_Label", "Claim_Probability", "RPM_per_Speed", "Load_per_RPM")


@query("M6_time_split", """SELECT event_id, CASE WHEN epoch_us(Last_Update) >= (SELECT quantile_cont(epoch_us(Last_Update) * 1e0, 0.8) FROM history) THEN 'test' ELSE 'train' END AS part FROM history""")
def _(v):
    early, late = modeling.time_split(v.history.select("event_id", "Plate", "Last_Update"), 0.2)
    return early.select("event_id", F.lit("train").alias("part")).unionByName(late.select("event_id", F.lit("test").alias("part")))


_CODED = ("Status", "City", "Type", "Make", "Model", "Class", "Usage", "Time_of_Day", "Day_of_Week")


@query("M4_encoded_features", f"""SELECT event_id, {', '.join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'missing')) - 1 AS DOUBLE) AS {c}" for c in _CODED)},
  CASE WHEN Weather = 'Stormy' THEN 1e0 ELSE 0e0 END AS Weather_Stormy, CASE WHEN Road_Type = 'Urban' THEN 1e0 ELSE 0e0 END AS Road_Type_Urban,
  {r('Speed_kmh')}, {r('Night_Driving_Flag', 'Night_Driving_Flag')}, (SELECT count(DISTINCT Road_Type) + count(DISTINCT Weather) - 2 FROM h_prepared) AS dummies,
  CASE WHEN Road_Type = (SELECT min(Road_Type) FROM h_prepared) THEN 0 ELSE 1 END + CASE WHEN Weather = (SELECT min(Weather) FROM h_prepared) THEN 0 ELSE 1 END AS dummies_set FROM h_prepared""")
def _(v):
    labelled = v.h_prepared.drop("Trip_ID")
    encoder = modeling.fit_features(labelled)
    encoded = encoder.transform(labelled)
    plain = len(encoder.numeric) + len(encoder.coded)
    hot = F.slice(vector_to_array("features"), plain + 1, max(1, encoder.size - plain))
    return encoded.select(F.col("event_id").cast("long").alias("event_id"), *_CODED, "Weather_Stormy", "Road_Type_Urban", "Speed_kmh", F.col("Night_Driving_Flag").cast("double").alias("Night_Driving_Flag"),
                          F.lit(encoder.size - plain).cast("long").alias("dummies"), F.aggregate(hot, F.lit(0.0), lambda a, b: a + b).cast("int").alias("dummies_set"))


# --- tests on a labelled history -------------------------------------------------------
def _sample(v):
    """A label, a score with ties, and skewed numbers from the history alone."""
    return v.history.select(
        "event_id", (F.col("event_id") * 31 % 7 < 3).cast("int").alias("Risk_Label"), F.col("Speed_kmh").alias("speed"),
        "RPM", "Engine_Load_pct", "City", "Weather", "Status",
        (F.pmod(F.col("event_id") * 31, F.lit(7)) * 5 + F.pmod(F.col("event_id"), F.lit(53))).cast("double").alias("mixed"),
        ((F.pmod(F.col("event_id") * 17, F.lit(40)) + F.lit(20) * (F.pmod(F.col("event_id") * 31, F.lit(7)) < 3).cast("int")) / F.lit(64.0)).alias("p"))


_SAMPLE = """sample AS MATERIALIZED (SELECT event_id, CASE WHEN event_id * 31 % 7 < 3 THEN 1 ELSE 0 END AS Risk_Label, Speed_kmh AS speed, RPM, Engine_Load_pct, City, Weather, Status,
  (event_id * 31 % 7 * 5 + event_id % 53) * 1e0 AS mixed, (event_id * 17 % 40 + 20 * CASE WHEN event_id * 31 % 7 < 3 THEN 1 ELSE 0 END) / 64e0 AS p FROM history)"""
_MEASURES = ("speed", "RPM", "Engine_Load_pct", "mixed")


def _mid(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0"


@query("M10_classification_metrics", f"""WITH {_SAMPLE}, k AS (SELECT Risk_Label AS y, p, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS h, {_mid('p')} AS rk FROM sample),
  t AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM k GROUP BY p),
  c AS (SELECT t.*, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(pos + neg) OVER (ORDER BY p DESC) AS n FROM t)
  SELECT {r('avg(CASE WHEN h = y THEN 1e0 ELSE 0e0 END)', 'accuracy')}, {r('2e0 * sum(h * y) / (sum(h) + sum(y))', 'f1_score')}, {r('sum(h * y) * 1e0 / sum(h)', '"precision"')},
  {r('sum(h * y) * 1e0 / sum(y)', 'recall')}, {r('avg((p - y) * (p - y))', 'brier_score')},
  {r('avg(-(y * ln(greatest(least(p, 1e0 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - y) * ln(1e0 - greatest(least(p, 1e0 - 2.220446049250313e-16), 2.220446049250313e-16))))', 'log_loss')},
  count(*) AS n, {r('(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * 1e0 * (count(*) - sum(y)))', 'roc_auc')},
  {r('(SELECT sum(pos * 1e0 * tp / n) / sum(pos) FROM c)', 'average_precision')} FROM k""")
def _(v):
    return statistics.classification_metrics(_sample(v), "p", "Risk_Label")


@query("M14_mann_whitney", "WITH " + _SAMPLE + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r('u', 'statistic', 2)}, {r('greatest(z, 0e0)', 'z', 3)}, n1 AS n_group1, n0 AS n_group0 FROM (SELECT u, n1, n0, (abs(u - n1 * n0 / 2e0) - 0.5e0) /
    sqrt(n1 * n0 / 12e0 * (n1 + n0 + 1e0 - ties / ((n1 + n0) * (n1 + n0 - 1e0)))) AS z FROM (SELECT sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0 AS u,
    CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, (SELECT sum(t * 1e0 * t * t - t) FROM (SELECT count(*) AS t FROM sample GROUP BY {c})) AS ties
    FROM (SELECT Risk_Label AS y, {_mid(c)} AS rk FROM sample)))""" for c in _MEASURES))
def _(v):
    out = statistics.mann_whitney(_sample(v), _MEASURES).select("feature", "statistic", F.greatest("z", F.lit(0.0)).alias("z"), "n_group1", "n_group0")
    return settled(out, {"statistic": 2, "z": 3})


def _chi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {r("CASE WHEN lv = 2 THEN power(greatest(g - 0.5e0, 0e0), 2) * inv ELSE chi END", 'chi2', 3)}, CAST(lv - 1 AS BIGINT) AS dof, lv AS n_levels FROM (
    SELECT sum(power(n - e, 2) / e) AS chi, max(abs(n - e)) AS g, sum(1e0 / e) AS inv, count(DISTINCT level) AS lv FROM (SELECT a.level, b.y, coalesce(x.n, 0) AS n, a.rn * 1e0 * b.cn / tn AS e FROM
    (SELECT coalesce({c}, 'Missing') AS level, count(*) AS rn FROM sample GROUP BY 1) a, (SELECT Risk_Label AS y, count(*) AS cn FROM sample GROUP BY 1) b,
    (SELECT count(*) AS tn FROM sample) t LEFT JOIN (SELECT coalesce({c}, 'Missing') AS level, Risk_Label AS y, count(*) AS n FROM sample GROUP BY 1, 2) x ON a.level = x.level AND b.y = x.y))"""


@query("M15_chi_square", "WITH " + _SAMPLE + " " + " UNION ALL ".join(_chi(c) for c in ("City", "Weather", "Status")))
def _(v):
    return settled(statistics.chi_square(_sample(v), ("City", "Weather", "Status")).select("feature", "chi2", "dof", "n_levels"), 3)


@query("M16_spearman", "WITH " + _SAMPLE + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r('corr(a, b)', 'correlation')}, abs(corr(a, b)) > 0.9e0 AS high_correlation, count(*) AS n FROM (SELECT {_mid(c)} AS a, {_mid('p')} AS b FROM sample)"
    for c in _MEASURES))
def _(v):
    return statistics.spearman(_sample(v), "p", _MEASURES).select("feature", "correlation", "high_correlation", "n")


@query("M17_ks_two_sample", f"""WITH {_SAMPLE}, t AS (SELECT p, sum(Risk_Label) AS a, sum(1 - Risk_Label) AS b FROM sample GROUP BY p),
  c AS (SELECT sum(a) OVER (ORDER BY p) * 1e0 / (SELECT sum(a) FROM t) AS fa, sum(b) OVER (ORDER BY p) * 1e0 / (SELECT sum(b) FROM t) AS fb FROM t)
  SELECT {r('max(abs(fa - fb))', 'statistic')}, (SELECT CAST(sum(a) AS BIGINT) FROM t) AS n_pos, (SELECT CAST(sum(b) AS BIGINT) FROM t) AS n_neg FROM c""")
def _(v):
    return statistics.ks_two_sample(_sample(v), "p", "Risk_Label").select("statistic", "n_pos", "n_neg")


def _jb(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {r('n / 6e0 * (power(m3 / power(m2, 1.5e0), 2) + power(m4 / (m2 * m2) - 3e0, 2) / 4e0)', 'statistic', 3)}, n FROM (SELECT count(*) AS n,
    avg(power({c} - m, 2)) AS m2, avg(power({c} - m, 3)) AS m3, avg(power({c} - m, 4)) AS m4 FROM sample, (SELECT avg({c}) AS m FROM sample) q)"""


@query("M18_normality", "WITH " + _SAMPLE + " " + " UNION ALL ".join(_jb(c) for c in _MEASURES))
def _(v):
    return settled(statistics.normality(_sample(v), _MEASURES).select("feature", "statistic", "n"), 3)


_ACT = """acted AS MATERIALIZED (SELECT event_id, greatest(base, 1e0) AS base, s, a, CASE WHEN s >= 0.82e0 THEN 3 WHEN s >= 0.66e0 THEN 2 WHEN s >= 0.45e0 THEN 1 ELSE 0 END AS least_action, y FROM
  (SELECT event_id, event_id % 997 * 1e0 AS base, event_id % 101 / 1e2 AS s, event_id % 4 AS a, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM history))"""


def _acted(v):
    e = F.col("event_id")
    return v.history.select("event_id", (e % 997).cast("double").alias("Base_Price_USD"), (e % 101 / F.lit(100.0)).alias("Risk_Score"),
                            (e % 4).cast("int").alias("action"), (e % 3 == 0).cast("int").alias("Risk_Label"))


def _by(values) -> str:
    return "(CASE ea " + " ".join(f"WHEN {i} THEN {S.lit(float(x))}" for i, x in enumerate(values)) + " END)"


@query("M12_evaluate_policy", f"""WITH {_ACT}, q AS (SELECT b.*, (base * {_by(K.EVAL_PREMIUM_MULTIPLIER)} - base * (0.05e0 + 0.35e0 * s) * {_by(K.EVAL_LOSS_MULTIPLIER)} - {_by(K.EVAL_INTERVENTION_COST)}
  - CASE WHEN a < least_action THEN 250e0 ELSE 0e0 END - CASE WHEN a = 3 AND y = 0 THEN 90e0 ELSE 0e0 END + CASE WHEN ea <> 3 THEN 2e0 ELSE -5e0 END) / 1e2 AS reward
  FROM (SELECT t.*, greatest(a, least_action) AS ea FROM acted t) b)
  SELECT {r('avg(reward)', 'avg_reward')}, {r('avg(CASE WHEN a < least_action THEN 1e0 ELSE 0e0 END)', 'violation_rate')}, {', '.join(f"count(CASE WHEN a = {i} THEN 1 END) AS {n}_count" for i, n in enumerate(K.POLICY_ACTIONS))},
  {r('median(reward)', 'median_reward')} FROM q""")
def _(v):
    return statistics.evaluate_policy(_acted(v), "action")


def _reward(i: int) -> str:
    bonus = (18.0, 12.0, 0.0, 0.0)[i] + (1.5 if i != 3 else -4.0)
    decline = " - CASE WHEN y = 0 THEN 90e0 ELSE 0e0 END" if i == 3 else ""
    return (f"(base * {S.lit(K.EVAL_PREMIUM_MULTIPLIER[i])} - base * (0.05e0 + 0.35e0 * s) * {S.lit(K.EVAL_LOSS_MULTIPLIER[i])} - {S.lit(K.EVAL_INTERVENTION_COST[i])}"
            f" + {S.lit(bonus)} - CASE WHEN {i} < least_action THEN 320e0 ELSE 0e0 END{decline}) / 1e2")


@query("M13_action_rewards", f"""WITH {_ACT}, q AS (SELECT event_id, {', '.join(f"{_reward(i)} AS r{i}" for i in range(4))} FROM acted)
  SELECT event_id, {', '.join(r(f'r{i}', f'reward_{n}') for i, n in enumerate(K.POLICY_ACTIONS))}, CASE greatest(r0, r1, r2, r3) WHEN r0 THEN 0 WHEN r1 THEN 1 WHEN r2 THEN 2 ELSE 3 END AS best_action FROM q""")
def _(v):
    return statistics.action_rewards(_acted(v)).select("event_id", *[f"reward_{n}" for n in K.POLICY_ACTIONS], "best_action")


@query("S7_exact_quantiles", f"SELECT City, {', '.join(r(f'quantile_cont(Speed_kmh, {p})', f'q{int(p * 100)}') for p in (0.05, 0.25, 0.5, 0.95))} FROM history GROUP BY City")
def _(v):
    return ranks.grouped_quantiles(v.history, "Speed_kmh", {"q5": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95}, ["City"])


# --- the model: all columns, the operators' own rounds and depth ------------------------
_RUNS: dict[tuple, dict] = {}


def _trained(v) -> dict:
    """One training run for a session and data folder, shared by the queries that report on it."""
    from fleetrisk.plans.training import train
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in _RUNS:
        _RUNS[key] = train(v.h_prepared)
    return _RUNS[key]


def _encoded(v):
    labelled = settle(_labelled(v), "labelled")
    encoder = modeling.fit_features(labelled)
    return encoder, settle(encoder.transform(labelled, show_dummies=False), "encoded")


@query("M7_M8_model_scores")
def _(v):
    return _trained(v)["scored_test"].select("event_id", "Risk_Label", "Predicted_Risk_Score", "Predicted_Risk_Label")


@query("M20_smallest_p_values")
def _(v):
    return _trained(v)["smallest_p_values"]


@query("Q5_training_metrics")
def _(v):
    run = _trained(v)
    return run["metrics"].select(F.lit("test").alias("part"), "*").union(run["validation_metrics"].select(F.lit("validation"), "*"))


@query("M9_permutation_importance")
def _(v):
    return _trained(v)["importance"]


_SCALED = ("Speed_kmh", "RPM", "Engine_Load_pct", "Coolant_Temp_C", "Battery_V", "Recent_Harsh_Events", "Fatigue_Risk_Score", "Update_Hour",
           "RPM_per_Speed")


@query("M11_standardise", f"""WITH {_TRAIN}, c AS (SELECT l.*, {', '.join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'missing')) - 1 AS DOUBLE) AS x_{c}" for c in ('City', 'Make', 'Type'))} FROM labelled l)
  SELECT event_id, {', '.join(r(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0e0 END", f"scaled_{c.removeprefix('x_')}") for c in (*_SCALED, 'x_City', 'x_Make', 'x_Type'))} FROM c""")
def _(v):
    encoder, encoded = _encoded(v)
    scaled = vector_to_array("scaled")
    shown = [*_SCALED, "City", "Make", "Type"]
    return modeling.standardise(encoded).select(F.col("event_id").cast("long").alias("event_id"), *[scaled[(encoder.numeric + encoder.coded).index(c)].alias(f"scaled_{c}") for c in shown])


@query("M19_odds_ratios")
def _(v):
    encoder, encoded = _encoded(v)
    return modeling.odds_ratios(encoded, encoder.names(v.spark))


@query("M19_fitted_mean", f"WITH {_TRAIN} SELECT count(*) AS observations, {r('avg(Risk_Label)', 'mean_fitted_probability', 6)} FROM labelled", 6)
def _(v):
    _, encoded = _encoded(v)
    fitted = modeling.fit_logistic(encoded).probability()
    return encoded.agg(F.count(F.lit(1)).alias("observations"), F.avg(fitted).alias("mean_fitted_probability"))
