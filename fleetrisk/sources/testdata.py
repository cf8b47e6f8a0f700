"""Telemetry views over the star-schema test tables.

The definitions are plain SQL expressions that mean the same in every ANSI engine:
integer remainders, CASE, and double literals in exponent form. Speeds and accelerations
are whole quarters and eighths, so that their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import calendar as cal

CITIES = list(K.CITY_CENTROIDS)
_MAKES = ("Toyota", "Honda", "Nissan", "Mazda", "Ford", "Isuzu", "BMW", "Volvo")
_ROADS = ("Highway", "Gravel", "Potholed", "Local Streets", "Urban", "Rural Tarred")
_WEATHER = ("Sunny", "Cloudy", "Windy", "Rainy", "Hot", "Snowy", "Stormy")


def _by_remainder(key: str, names, rest: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return f"CASE {key} % {len(names) + 1} {cases} ELSE {rest} END"


def _city_value(key: str, axis: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {K.CITY_CENTROIDS[c][axis]}e0" for i, c in enumerate(CITIES))
    default = K.CITY_CENTROIDS[K.DEFAULT_CITY][axis]
    return f"CASE {key} % {len(CITIES) + 1} {cases} ELSE {default}e0 END"


HISTORY = (
    ("event_id", "event_id"),
    ("Plate", "concat('V', CAST(user_id AS STRING))"),
    ("Last_Update", "ts"),
    ("Speed_kmh", "floor(value * 4e0) / 4e0"),
    ("Status", "CASE WHEN event_type = 'error' THEN 'Parked' ELSE 'Driving' END"),
    ("City", _by_remainder("user_id", CITIES, "'Unknown'")),
    ("Road_Type", _by_remainder("event_id", _ROADS, "NULL")),
    ("Weather", _by_remainder("event_id", _WEATHER, "NULL")),
    ("Acceleration_mps2", "(event_id * 7 % 128) / 8e0 - 8e0"),
    ("RPM", "CAST(700 + event_id * 37 % 4000 AS DOUBLE)"),
    ("Engine_Load_pct", "CAST(event_id * 13 % 100 AS DOUBLE)"),
    ("Coolant_Temp_C", "CAST(70 + event_id * 11 % 45 AS DOUBLE)"),
    ("Battery_V", "1e1 + (event_id * 3 % 56) / 1e1"),
    ("MAF_gs", "CAST(event_id * 19 % 160 AS DOUBLE)"),
    ("Harsh_Brake_Count", "CAST(event_id % 4 AS INT)"),
    ("Harsh_Accel_Count", "CAST(event_id % 3 AS INT)"),
    ("Harsh_Corner_Count", "CAST(event_id % 5 AS INT)"),
    ("Trip_Distance_km", "CAST(event_id * 17 % 60 AS DOUBLE)"),
    ("Trip_Duration_Hour", "(event_id % 50) / 1e1"),
    ("Speeding_Flag", "CAST(CASE WHEN value > 8e1 THEN 1 ELSE 0 END AS INT)"),
)

PORTFOLIO = (
    ("c_custkey", "c_custkey"),
    ("Plate", "concat('V', CAST(c_custkey AS STRING))"),
    ("Type", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Sedan' WHEN 'BUILDING' THEN 'Pickup'"
             " WHEN 'FURNITURE' THEN 'Van' WHEN 'HOUSEHOLD' THEN 'Kombi' ELSE 'Heavy Truck' END"),
    ("Usage", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Private' ELSE 'Commercial' END"),
    ("City", _by_remainder("c_nationkey", CITIES, "'Unknown'")),
    ("Year", "CAST(2006 + c_custkey % 20 AS INT)"),
    ("Engine_CC", "CAST(1000 + c_custkey % 9 * 500 AS INT)"),
    ("Base_Price_USD", "greatest(c_acctbal, 0e0) * 5e0 + 5e2"),
    ("Make", _by_remainder("c_custkey", _MAKES[:7], f"'{_MAKES[7]}'")),
    ("Model", "concat('M', CAST(c_custkey % 30 AS STRING))"),
    ("GPS_Latitude", f"{_city_value('c_nationkey', 0)} + (c_custkey % 31 - 15) / 1e2"),
    ("GPS_Longitude", f"{_city_value('c_nationkey', 1)} + (c_custkey % 31 - 15) / 1e2"),
)

# Telemetry that a portfolio row takes from the last history row of its vehicle.
TELEMETRY = tuple(name for name, _ in HISTORY if name not in ("event_id", "Plate", "City")) + (
    "Time_of_Day", "Day_of_Week")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry history from ``events``: one row per observation."""
    rows = table(spark, sf_dir, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in HISTORY])
    return rows.withColumns({"Time_of_Day": cal.time_of_day(F.col("Last_Update")),
                             "Day_of_Week": cal.day_name(F.col("Last_Update"))})


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles from ``customer`` with the telemetry of their last observation, where they have one."""
    fleet = table(spark, sf_dir, "customer").selectExpr(*[f"{sql} AS {name}" for name, sql in PORTFOLIO])
    latest = history(spark, sf_dir).groupBy("Plate").agg(
        F.max_by(F.struct(*TELEMETRY), F.struct("Last_Update", "event_id")).alias("seen"))
    return fleet.join(latest, "Plate", "left").select(*fleet.schema.names, "seen.*")


def supply_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger history from ``lineitem``: driver ``l_suppkey``, time ``l_shipdate``; times repeat."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', CAST(l_suppkey AS STRING)) AS Plate", "l_shipdate AS Last_Update",
        "l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus END AS City",
        "CASE WHEN l_returnflag = 'R' THEN 'Parked' ELSE 'Driving' END AS Status",
        "l_quantity * 4e0 AS Speed_kmh", "(l_orderkey * 7 % 128) / 8e0 - 8e0 AS Acceleration_mps2",
        "CAST(l_orderkey * 13 % 100 AS DOUBLE) AS Engine_Load_pct",
        "CAST(70 + l_orderkey * 11 % 45 AS DOUBLE) AS Coolant_Temp_C",
        "CAST(l_orderkey * 17 % 60 AS DOUBLE) AS Trip_Distance_km",
        "CAST(l_orderkey % 4 AS INT) AS Harsh_Brake_Count", "CAST(l_linenumber % 3 AS INT) AS Harsh_Accel_Count",
        "CAST(l_orderkey % 5 AS INT) AS Harsh_Corner_Count",
        "CAST(l_linenumber % 2 AS INT) AS Night_Driving_Flag",
        "CAST(CASE WHEN l_quantity > 2e1 THEN 1 ELSE 0 END AS INT) AS Speeding_Flag")
