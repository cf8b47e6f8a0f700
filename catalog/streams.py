"""Streaming queries, run over the event table to its end and read back from their sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import AS_OF, query, r
from fleetrisk.functions import calendar as cal
from fleetrisk.functions.runtime import shared_folder
from fleetrisk.operators.features import preprocess
from fleetrisk.operators.filters import fresh_rows
from fleetrisk.sources.testdata import HISTORY
from fleetrisk.streaming import live


def _events(v) -> DataFrame:
    """The history view as a stream of the table's files, whether it is a file or a folder.

    Watermarks need a zoned timestamp. The path is a pattern of that one name: Spark takes
    a plain path of a stream for a folder's, a pattern may also name a file.
    """
    stream = v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.dir}/[e]vents.parquet")
    rows = stream.selectExpr(*[f"{sql} AS {name}" for name, sql in HISTORY])
    return rows.withColumns({"Last_Update": F.col("Last_Update").cast("timestamp"),
                             "Time_of_Day": cal.time_of_day(F.col("Last_Update")),
                             "Day_of_Week": cal.day_name(F.col("Last_Update"))})


def _folder(v) -> str:
    return f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"


def _drained(v, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a Parquet table and read that back."""
    folder = _folder(v)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/rows"))
    writer.start().awaitTermination()
    rows = v.spark.read.parquet(f"{folder}/rows")
    for name, kind in rows.dtypes:
        if kind == "timestamp":
            rows = rows.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return rows


def _last_batch(rows: DataFrame, key: str = "Plate") -> DataFrame:
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(key, "row.*")


@query("T1_scored_stream", f"SELECT event_id, {r('Calculated_Risk_Score')}, Risk_Band, PPO_Action FROM h_priced")
def _(v):
    ready = preprocess(_events(v), AS_OF, plates_known=True)
    return _drained(v, live.score_stream(ready).select("event_id", "Calculated_Risk_Score", "Risk_Band", "PPO_Action"))


@query("T2_latest_snapshot", f"SELECT Plate, event_id, {r('Speed_kmh')}, Status FROM latest")
def _(v):
    rows = _drained(v, live.latest_snapshot(_events(v).select("Plate", "Last_Update", "event_id", "Speed_kmh", "Status")), "update")
    return _last_batch(rows).select("Plate", "event_id", "Speed_kmh", "Status")


_CLOSED = "<= (SELECT max(Last_Update) - INTERVAL 10 MINUTES FROM history)"


@query("T3_speed_windows", f"""SELECT * FROM (SELECT time_bucket(INTERVAL 30 MINUTES, Last_Update) AS window_start, {r('avg(Speed_kmh)', 'Speed_kmh')}, count(*) AS observations FROM history GROUP BY 1)
  WHERE window_start + INTERVAL 30 MINUTES {_CLOSED}""")
def _(v):
    return _drained(v, live.speed_windows(_events(v)))


@query("T4_captured_history", "SELECT DISTINCT Plate, Last_Update FROM history")
def _(v):
    return _drained(v, live.captured_history(_events(v).select("Plate", "Last_Update")))


_HOLDS = "CASE {0} WHEN 'Critical' THEN 72 WHEN 'High' THEN 48 WHEN 'Medium' THEN 24 WHEN 'Low' THEN 12 ELSE 24 END * INTERVAL 1 HOUR"


@query("T5_sticky_severities", f"""SELECT * FROM (WITH RECURSIVE a AS (SELECT Plate, Last_Update, Speed_kmh / 300 AS score, CASE WHEN Speed_kmh / 300 >= 0.6 THEN 'Critical'
  WHEN Speed_kmh / 300 >= 0.4 THEN 'High' WHEN Speed_kmh / 300 >= 0.2 THEN 'Medium' ELSE 'Low' END AS candidate FROM history WHERE Last_Update {_CLOSED}),
  n AS (SELECT *, row_number() OVER (PARTITION BY Plate ORDER BY Last_Update, candidate, score) AS k FROM a),
  s AS (SELECT Plate, k, Last_Update, candidate AS level, Last_Update AS since, score FROM n WHERE k = 1 UNION ALL
    SELECT n.Plate, n.k, n.Last_Update, CASE WHEN n.Last_Update >= s.since + {_HOLDS.format('s.level')} THEN candidate ELSE level END,
      CASE WHEN n.Last_Update >= s.since + {_HOLDS.format('s.level')} THEN n.Last_Update ELSE since END,
      CASE WHEN n.Last_Update >= s.since + {_HOLDS.format('s.level')} THEN n.score ELSE s.score END FROM s JOIN n ON n.Plate = s.Plate AND n.k = s.k + 1)
  SELECT Plate, Last_Update, level AS Severity, since AS last_updated, {r('score', 'composite_score')}, false AS Hold_Over FROM s UNION ALL
  SELECT Plate, since + {_HOLDS.format('level')}, level, since, {r('score', 'composite_score')}, true FROM s
  WHERE since = Last_Update AND since + {_HOLDS.format('level')} {_CLOSED})""")
def _(v):
    score = F.col("Speed_kmh") / 300
    rows = _events(v).select("Plate", "Last_Update", score.alias("Composite_Score"), F.when(score >= 0.6, "Critical").when(
        score >= 0.4, "High").when(score >= 0.2, "Medium").otherwise("Low").alias("Candidate_Severity"))
    return _drained(v, live.sticky_severities(rows))


@query("T6_smoothed_scores", f"""SELECT * FROM (WITH RECURSIVE n AS (SELECT Plate, Last_Update, least(Speed_kmh / 200, 1e0) AS score, row_number() OVER (PARTITION BY Plate
    ORDER BY Last_Update, least(Speed_kmh / 200, 1e0)) AS k FROM history WHERE Last_Update {_CLOSED}),
  s AS (SELECT Plate, k, Last_Update, greatest(score, 0e0) AS shown FROM n WHERE k = 1 UNION ALL
    SELECT n.Plate, n.k, n.Last_Update, least(greatest(shown + least(greatest(greatest(score, 0e0) - shown, -2e-2), 2e-2), 0e0), 1e0)
    FROM s JOIN n ON n.Plate = s.Plate AND n.k = s.k + 1)
  SELECT Plate, Last_Update, {r('shown', 'Calculated_Risk_Score')} FROM s)""")
def _(v):
    rows = _events(v).select("Plate", "Last_Update", F.least(F.col("Speed_kmh") / 200, F.lit(1.0)).alias("Calculated_Risk_Score"))
    return _drained(v, live.smoothed_scores(rows))


@query("T7_running_counters", f"""SELECT Plate, {r('sum(CASE WHEN dh IS NULL THEN harsh ELSE greatest(dh, 0) END)', 'harsh_event_total')},
  {r('sum(CASE WHEN dk IS NULL THEN Trip_Distance_km ELSE greatest(dk, 0e0) END)', 'trip_distance_km')}, count(*) AS observation_count FROM (SELECT k.*,
  harsh - lag(harsh) OVER w AS dh, Trip_Distance_km - lag(Trip_Distance_km) OVER w AS dk FROM
  (SELECT h.*, Harsh_Brake_Count + Harsh_Accel_Count + Harsh_Corner_Count AS harsh FROM history h) k WINDOW w AS (PARTITION BY Plate ORDER BY Last_Update, event_id)) GROUP BY Plate""")
def _(v):
    rows = _drained(v, live.running_counters(_events(v)), "update")
    return _last_batch(rows).select("Plate", "harsh_event_total", "trip_distance_km", "observation_count")


@query("T8_trip_windows", f"""WITH d AS (SELECT Plate, Last_Update, Speed_kmh, CASE WHEN Last_Update - lag(Last_Update) OVER (PARTITION BY Plate ORDER BY Last_Update) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
  FROM history WHERE Status = 'Driving'), s AS (SELECT d.*, sum(fresh) OVER (PARTITION BY Plate ORDER BY Last_Update) AS trip FROM d)
  SELECT Plate, min(Last_Update) AS trip_start, max(Last_Update) + INTERVAL 30 MINUTES AS trip_end, count(*) AS observations, {r('avg(Speed_kmh)', 'avg_speed_kmh')} FROM s
  GROUP BY Plate, trip HAVING max(Last_Update) + INTERVAL 30 MINUTES {_CLOSED}""")
def _(v):
    return _drained(v, live.trip_windows(_events(v)))


@query("T9_fresh_results", "SELECT Plate, event_id FROM latest WHERE Last_Update >= TIMESTAMP '2024-01-30 00:00:00'")
def _(v):
    rows = _drained(v, live.latest_snapshot(_events(v).select("Plate", "Last_Update", "event_id")), "update")
    return fresh_rows(_last_batch(rows), AS_OF, 2 * 86400).select("Plate", "event_id")
