"""Hand-worked values of the row-level expressions on literal rows."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import calendar as cal
from fleetrisk.functions import pricing as px
from fleetrisk.functions import risk
from fleetrisk.functions.columns import Presence, half_even, num
from fleetrisk.operators import cleaning, features, fraud, joins, pricing, scoring

AS_OF = datetime(2024, 2, 1)


def one(df, *columns):
    return [tuple(row) if len(columns) != 1 else row[0] for row in df.select(*columns).collect()]


def test_bins_edges_null_nan_and_text(spark):
    rows = [(1, "0"), (2, "1.01"), (3, str(1.01 - 1e-9)), (4, "1.3"), (5, "-1"), (6, None), (7, "nan"), (8, "abc")]
    df = spark.createDataFrame(rows, "i int, v string").coalesce(1)
    df = df.withColumn("n", num(df, "v"))
    vector = one(df.orderBy("i"), risk.vector_bin(F.col("n"), K.SPEED_RATIO_BINS, 0.0))
    assert vector == [0.0, 0.2, 0.0, 0.9, 0.0, 0.0, 0.0, 0.0]
    scalar = one(df.orderBy("i"), risk.scalar_bin(F.col("n"), K.SPEED_RATIO_BINS))
    assert scalar == [0.0, 0.2, 0.0, 0.9, 0.9, 0.5, 0.5, 0.5]


def test_band_edges(spark):
    values = [0.3099, 0.31, 0.5099, 0.51, 0.8099, 0.81, -1.0, 2.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert one(df.orderBy("i"), risk.band(F.col("v"))) == [
        "Low", "Medium", "Medium", "High", "High", "Critical", "Low", "Critical", "Medium"]


def test_time_of_day_edges(spark):
    times = ["01:59:59", "02:00:00", "04:59:59", "05:00:00", "10:00:00", "17:00:00", "20:00:00", "22:00:00"]
    df = spark.createDataFrame([(i, f"2024-01-01 {t}") for i, t in enumerate(times)], "i int, t string")
    got = one(df.orderBy("i"), cal.time_of_day(F.to_timestamp("t")))
    assert got == ["Late Night", "Dawn", "Dawn", "Morning Rush", "Mid-Day", "Evening Rush", "Night", "Late Night"]


def test_rounding_is_half_even_on_the_scaled_double(spark):
    df = spark.createDataFrame([(0, 0.125), (1, 0.375), (2, 1.005)], "i int, v double")
    assert one(df.orderBy("i"), half_even(F.col("v"), 2)) == [0.12, 0.38, 1.0]


@pytest.mark.parametrize("values, expected", [
    ([None, None, None], [0.65, 0.1, 0.3]), ([0.5, None, 1.3], [0.5, None, 1.0]), ([None, 0.9, None], [None, 0.9, None])])
def test_whole_column_fallback(spark, values, expected):
    labels = ["Rainy", "Sunny", None]
    df = spark.createDataFrame(list(zip(range(3), labels, values)), "i int, Weather string, Weather_Risk_Score double")
    filled = Presence(df, risk.ENVIRONMENT_SCORES)
    assert one(df.orderBy("i"), risk.weather(df, filled)) == expected
    plain = df.drop("Weather_Risk_Score")
    assert one(plain.orderBy("i"), risk.weather(plain, Presence(plain, risk.ENVIRONMENT_SCORES))) == [0.65, 0.1, 0.3]


def test_smoothing(spark):
    df = spark.createDataFrame([(0, 0.4, None), (1, 0.42, 0.4), (2, 0.421, 0.4), (3, 0.0, 0.5), (4, None, 0.5)],
                               "i int, s double, p double")
    got = one(df.orderBy("i"), risk.smooth(F.col("s"), F.col("p")))
    assert got[4] is None
    assert [round(x, 6) for x in got[:4]] == [0.4, 0.42, 0.42, 0.48]


def test_class_surcharges(spark):
    rows = [("a", "Kombi", "Private", 11.0), ("b", "Kombi", "Private", 12.0), ("c", "Sedan", "Private", 5.0),
            ("d", "Sedan", "Commercial", 5.0), ("e", "Pickup", "Private", 5.0)]
    df = spark.createDataFrame(rows, "Plate string, Type string, Usage string, Vehicle_Age_Years double")
    got = {r["Plate"]: r["Calculated_Risk_Score"] for r in scoring.live_risk_outputs(df).collect()}
    extra = {k: round(v - got["c"], 6) for k, v in got.items()}
    assert extra == {"a": 0.025, "b": 0.035, "c": 0.0, "d": 0.015, "e": 0.015}


def test_premium_floors_and_caps(spark):
    df = spark.createDataFrame([(0, "Tractor", 0.0), (1, "Heavy Truck", 1.0), (2, "Heavy Truck", 1.2), (3, "Unknown", 0.5)],
                               "i int, t string, r double")
    got = one(df.orderBy("i"), px.daily_premium(F.col("r"), F.col("t")), px.monthly_premium(F.col("r"), F.col("t")))
    assert got[0] == (1.0, 30.0)
    assert (round(got[1][0], 2), round(got[1][1], 2)) == (13.0, 390.0)
    assert got[2] == (13.33, 400.0)
    assert math.isclose(got[3][1], 600 * (0.62 + 0.5 * 1.33) / 12)


def test_profit_is_floored_and_supplied_premium_kept(spark):
    rows = [("a", 0.5, "Medium", 1e9, None), ("b", 0.5, "Medium", 1000.0, 100.0)]
    df = spark.createDataFrame(rows, "Plate string, Calculated_Risk_Score double, Risk_Band string, Base_Price_USD double, "
                                     "Monthly_Premium_USD double").withColumn("LightGBM_Risk_Score", F.lit(0.5))
    got = {r["Plate"]: r for r in pricing.profitability(df).collect()}
    assert got["a"]["Underwriting_Profit_USD"] == 0.0
    assert got["b"]["Monthly_Premium_USD"] == 100.0
    claim = 1000 * (0.01 + 0.5 * 0.44) * 0.1 / 12
    assert got["b"]["Underwriting_Profit_USD"] == round(100 - claim - (100 * 0.125 + 8.0 + 0.25), 2)
    assert got["b"]["Monthly_Premium_ZIG"] == 2650.0


def test_clean_portfolio_edges(spark):
    rows = [(0, " ", "499"), (1, "X", "abc"), (2, None, "800")]
    df = spark.createDataFrame(rows, "`Unnamed: 0` int, `Plate ` string, Base_Price_USD string").withColumn("n", F.col("Unnamed: 0"))
    got = cleaning.clean_portfolio(df, order_by="n").orderBy("n").collect()
    assert "Unnamed: 0" not in got[0].asDict()
    assert [r["Plate"] for r in got] == ["AAA1000", "X", "AAA1001"]
    assert [r["Base_Price_USD"] for r in got] == [500.0, 6000.0, 800.0]
    assert {(r["Type"], r["Usage"], r["Status"], r["City"]) for r in got} == {("Sedan", "Private", "Driving", "Harare")}


def test_placeholder_plate_carry(spark):
    df = spark.createDataFrame([(0,), (8999,), (9000,), (9000 * 26,), (9000 * 676 - 1,), (9000 * 676,), (2 * 9000 * 676,)], "i long")
    assert one(df.orderBy("i"), cleaning.placeholder_plate(F.col("i"))) == [
        "AAA1000", "AAA9999", "AAB1000", "ABA1000", "AZZ9999", "A1AA1000", "A2AA1000"]


def test_identical_rows_get_their_own_numbers(spark):
    from fleetrisk.operators.ranks import dense_numbers
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 5, "k string")
    numbers = [r["i"] for r in dense_numbers(df, "i", chunk=7).collect()]
    assert sorted(numbers) == list(range(30))


def test_overlay_writes_nulls_keeps_unmatched_adds_columns(spark):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), (None, 3.0, "z")], "Plate string, Speed_kmh double, City string")
    live = spark.createDataFrame([("a", 9.0, None, "Driving", 1), ("a", None, None, "Parked", 2)],
                                 "Plate string, Speed_kmh double, City string, Status string, t int")
    got = {r["Plate"]: tuple(r)[1:] for r in joins.refresh_live_columns(base, live, ["t"]).collect()}
    assert got == {"a": (None, None, "Parked"), "b": (2.0, "y", None), None: (3.0, "z", None)}


def test_positional_overlay_needs_a_row_id(spark):
    df = spark.range(3).withColumnRenamed("id", "n")
    with pytest.raises(ValueError):
        joins.positional_overlay(df, df, ["n"])


def test_fraud_rules_edges(spark):
    rows = [("a", 180.0, 7.0, 10.5), ("b", 180.1, 0.0, 12.0), ("c", 0.0, -7.1, 12.0), ("d", 0.0, 0.0, 15.1), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "Plate string, Speed_kmh double, Acceleration_mps2 double, Battery_V double")
    assert {r["Plate"]: r["Fraud_Flag"] for r in fraud.fraud_flags(df).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 0}
    calm = df.filter("Plate IN ('a', 'e')")
    assert [r["Status"] for r in fraud.fraud_table_or_status(calm).collect()] == ["No fraud detected"]


@pytest.mark.parametrize("top, flag", [(500 / 111, 0), (500.1 / 111, 1)])
def test_fleet_spread_flags_every_row(spark, top, flag):
    df = spark.createDataFrame([(0.0, 0.0), (top, 0.0)], "GPS_Latitude double, GPS_Longitude double")
    assert [r["Fraud_Flag"] for r in fraud.fraud_flags(df).collect()] == [flag, flag]


def test_robust_z_falls_back(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (1.0, 5.0, 2.0), (1.0, 5.0, 3.0), (9.0, 5.0, 4.0)],
                               "a double, b double, c double")
    rows = fraud.robust_z(df, ["a", "b", "c"]).orderBy("c").collect()
    assert [round(r["z_a"], 4) for r in rows] == [-0.5774, -0.5774, -0.5774, 1.7321]
    assert [r["z_b"] for r in rows] == [0.0] * 4
    assert [round(r["z_c"], 4) for r in rows] == [round(x / 1.4826, 4) for x in (-1.5, -0.5, 0.5, 1.5)]


def test_sticky_severity_hold(spark):
    rows = [("new", "Low", 0.1, None), ("inside", "Low", 0.1, None), ("at", "Low", 0.1, None), ("own", "Low", 0.1, 1.0)]
    df = spark.createDataFrame(rows, "Plate string, Candidate_Severity string, Composite_Score double, Severity_Hold_Hours double")
    state = spark.createDataFrame([("inside", "High", datetime(2024, 1, 30, 0, 0, 1), 0.7), ("at", "High", datetime(2024, 1, 30), 0.7),
                                   ("own", "High", datetime(2024, 1, 31, 22), 0.7), ("gone", "High", datetime(2024, 1, 1), 0.9)],
                                  "plate string, severity string, last_updated timestamp_ntz, composite_score double")
    result = fraud.sticky_severity(df, AS_OF, state)
    assert {r["Plate"]: r["Severity"] for r in result.collect()} == {"new": "Low", "inside": "High", "at": "Low", "own": "Low"}
    stored = {r["plate"]: (r["severity"], r["last_updated"]) for r in fraud.next_state(result, state).collect()}
    assert stored["inside"] == ("High", datetime(2024, 1, 30, 0, 0, 1))
    assert stored["at"] == ("Low", AS_OF) and stored["gone"] == ("High", datetime(2024, 1, 1))


def test_jitter_is_repeatable_and_small(spark):
    df = spark.createDataFrame([(f"V{i}", 0.5) for i in range(500)], "Plate string, Risk_Score double")
    a = sorted(map(tuple, scoring.jittered_scores(df, AS_OF).collect()))
    b = sorted(map(tuple, scoring.jittered_scores(df.repartition(7), AS_OF).collect()))
    assert a == b
    moves = {round(s - 0.5, 4) for _, s in a}
    assert moves == {-0.005, 0.0, 0.005}


def test_open_schema(spark):
    df = spark.createDataFrame([("a",)], "Plate string")
    row = features.preprocess(df, AS_OF).collect()[0]
    assert (row["Type"], row["Status"], row["Battery_V"], row["Time_of_Day"]) == ("Sedan", "Parked", 12.6, "Late Night")
    assert set(K.PREPROCESSED_COLUMNS) <= set(row.asDict())
