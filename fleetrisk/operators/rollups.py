"""Portfolio rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk import constants as K
from fleetrisk.functions import pricing as px
from fleetrisk.functions import risk
from fleetrisk.functions.columns import bound, first_num, has, lookup, num, round_columns, text
from fleetrisk.operators.joins import fixed_centroid
from fleetrisk.operators.ranks import grouped_quantiles, scalar_row
from fleetrisk.operators.scoring import canonical_scores, live_risk_outputs


def count_where(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def _sum(value: Column | str) -> Column:
    """Sum where an all-NULL column gives zero."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _median(df: DataFrame, value: str) -> Column:
    """Exact median of a column as a scalar subquery (distributed, see ``ranks``)."""
    return scalar_row(grouped_quantiles(df.select(F.col(value).cast("double").alias(value)), value,
                                        {"median": 0.5})).getField("median")


def risk_kpis(df: DataFrame) -> DataFrame:
    """One row of risk KPIs."""
    live = has(df, "Calculated_Risk_Score") and has(df, "Risk_Band")
    df = canonical_scores(df) if live else live_risk_outputs(df)
    claim = first_num(df, ("Expected_Claim", "Expected_Claim_USD")) if (
        has(df, "Expected_Claim") or has(df, "Expected_Claim_USD")) else lookup(
        K.BAND_EXPECTED_CLAIM, F.col("Risk_Band"), 2200.0)
    claim = F.coalesce(claim, F.lit(0.0))
    band, score, total = F.col("Risk_Band"), F.col("Calculated_Risk_Score"), F.count(F.lit(1))
    row = df.agg(
        total.alias("total_vehicles"), F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_risk_score"),
        *[count_where(band == b).alias(f"{b.lower()}_count") for b in K.BANDS],
        *[_share(count_where(band == b), total).alias(f"{b.lower()}_pct") for b in K.BANDS],
        count_where(band.isin("High", "Critical")).alias("high_risk_count"),
        count_where(band == "Critical").alias("critical_risk_count"),
        _sum(claim).alias("expected_claim_total"),
        F.coalesce(F.avg(claim), F.lit(0.0)).alias("expected_claim_avg"),
    )
    return row.withColumn("median_risk_score", F.coalesce(_median(df, "Calculated_Risk_Score"), F.lit(0.0)))


def review_action_counts(df: DataFrame) -> DataFrame:
    """Vehicles per review action."""
    action = (text(df, "Risk_Action") if has(df, "Risk_Action")
              else lookup(K.BAND_REVIEW_ACTION, F.col("Risk_Band"), "Monitor"))
    return value_counts(df.select(action.alias("Risk_Action")), "Risk_Action")


def band_summary(df: DataFrame, rescore: bool = True) -> DataFrame:
    """Exposure by band; ``rescore`` scores the rows once more first, as the live view does."""
    df = live_risk_outputs(df) if rescore else df
    return (df.groupBy("Risk_Band").agg(
        F.count("Risk_Band").alias("__n"), F.count("Plate").alias("Vehicles"), F.avg("Calculated_Risk_Score").alias("Avg_Risk_Score"),
        _sum("Expected_Claim").alias("Total_Expected_Claim"), F.avg("Expected_Claim").alias("Avg_Expected_Claim"))
        .filter("__n > 0").drop("__n").orderBy(F.desc("Avg_Risk_Score"), F.asc("Risk_Band")))


def modal(column: str) -> Column:
    """Most frequent value, the smallest on ties."""
    return F.mode(F.col(column), True)


def city_summary(df: DataFrame) -> DataFrame:
    """Risk by city with the modal band."""
    if not (has(df, "Calculated_Risk_Score") and has(df, "Risk_Band")):
        df = live_risk_outputs(df)
    return (df.filter(F.col("City").isNotNull()).groupBy("City").agg(
        F.count("Plate").alias("Vehicles"),
        F.avg("Calculated_Risk_Score").alias("Calculated_Risk_Score(avg)"),
        modal("Risk_Band").alias("Risk_Band"))
        .orderBy(F.desc("Calculated_Risk_Score(avg)"), F.asc("City")))


def recommendations(df: DataFrame, n: int = 20, rescore: bool = True) -> DataFrame:
    """L2: the vehicles to review first."""
    from fleetrisk.operators.filters import top_rows

    df = live_risk_outputs(df) if rescore else df
    return top_rows(df, "Calculated_Risk_Score", n, columns=K.RECOMMENDATION_COLUMNS)


def city_risk_premium(df: DataFrame) -> DataFrame:
    """G5"""
    out = df.filter(F.col("City").isNotNull()).groupBy("City").agg(
        F.count("Plate").alias("Vehicle_Count"), F.avg("Calculated_Risk_Score").alias("Avg_Risk_Score"),
        F.avg("Monthly_Premium_USD").alias("Avg_Premium"), modal("Risk_Band").alias("Risk_Level"))
    return round_columns(out, {"Avg_Risk_Score": 3, "Avg_Premium": 2})


def _premium_rollup(df: DataFrame, key: str, fallback: str) -> DataFrame:
    return df.select(
        text(df, key, None if has(df, key) else fallback).alias(key),
        num(df, "Monthly_Premium_USD", None if has(df, "Monthly_Premium_USD") else 50.0).alias("premium"),
        num(df, "Aggressive_Driving_Score").alias("aggressive"), num(df, "Speed_kmh").alias("speed"),
    )


def premium_by_city(df: DataFrame) -> DataFrame:
    """G6, with the short alias names."""
    out = _premium_rollup(df, "City", K.DEFAULT_CITY).filter("City IS NOT NULL").groupBy("City").agg(
        _sum("premium").alias("Total_Monthly_Premium_USD"),
        F.coalesce(F.avg("premium"), F.lit(0.0)).alias("Avg_Monthly_Premium_USD"),
        F.count("premium").alias("Vehicle_Count"),
        F.coalesce(F.avg("aggressive"), F.lit(0.0)).alias("Avg_Aggressive_Score"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("Avg_Speed_kmh"))
    return out.withColumns({"Total_Premium": F.col("Total_Monthly_Premium_USD"),
                            "Avg_Premium": F.col("Avg_Monthly_Premium_USD"), "Avg_Speed": F.col("Avg_Speed_kmh")})


def premium_by_band(df: DataFrame) -> DataFrame:
    """G7"""
    return _premium_rollup(df, "Risk_Band", "Medium").groupBy("Risk_Band").agg(
        F.count("Risk_Band").alias("__n"), _sum("premium").alias("Total_Premium"),
        F.coalesce(F.avg("premium"), F.lit(0.0)).alias("Avg_Premium"),
        F.count("premium").alias("Vehicle_Count"),
        F.coalesce(F.avg("aggressive"), F.lit(0.0)).alias("Avg_Aggressive_Score")).filter("__n > 0").drop("__n")


def band_order(band: Column) -> Column:
    return lookup({b: i for i, b in enumerate(K.BANDS)}, band)


def band_analysis(df: DataFrame) -> DataFrame:
    """Premium and profit by band, in the fixed band order."""
    out = df.groupBy("Risk_Band").agg(
        count_where(F.col("Risk_Band").isin(*K.BANDS)).alias("Vehicle_Count"),
        F.avg("Monthly_Premium_USD").alias("Avg_Premium"), _sum("Monthly_Premium_USD").alias("Total_Premium"),
        F.avg("Underwriting_Profit_USD").alias("Avg_Profit"),
        _sum("Underwriting_Profit_USD").alias("Total_Profit"))
    out = out.filter("Vehicle_Count > 0").orderBy(band_order(F.col("Risk_Band")))
    return round_columns(out, {c: 2 for c in ("Avg_Premium", "Total_Premium", "Avg_Profit", "Total_Profit")})


def city_analytics(df: DataFrame) -> DataFrame:
    """G9 + J4 + W6: money, risk, speed, position, level and vehicle share by city."""
    proxy = lookup(K.BAND_SCORE_PROXY, text(df, "Risk_Band", "Medium"), 0.45)
    named = [c for c in ("Risk_Score", "Calculated_Risk_Score", "LightGBM_Risk_Score") if has(df, c)]
    score = num(df, named[0], 0.45) if named else proxy
    premium = num(df, "Monthly_Premium_USD", 0.0)
    zig = (num(df, "Monthly_Premium_ZIG", 0.0) if has(df, "Monthly_Premium_ZIG")
           else premium * num(df, "USD_to_ZIG_Interbank_Rate", K.USD_TO_ZIG_RATE))

    def with_fallback_mean(name: str, plain: str) -> Column:
        """Amount whose NULLs take the mean of the plain column (zero without one)."""
        if not has(df, name):
            return num(df, plain, 0.0)
        if not has(df, plain) or not df.schema[name].nullable:
            return num(df, name, 0.0)
        mean = df.agg(F.avg(num(df, plain, 0.0))).scalar()
        return num(df, name, mean)

    working = df.select(
        text(df, "City", "Unknown").alias("City"),
        (text(df, "Plate") if has(df, "Plate") else F.xxhash64(*df.schema.names).cast("string")).alias("Plate"),
        bound(score, 0.0, 1.0).alias("risk"), bound(premium, low=0.0).alias("usd"),
        bound(zig, low=0.0).alias("zig"),
        bound(with_fallback_mean("Expected_Claim_USD", "Expected_Claim"), low=0.0).alias("claim"),
        with_fallback_mean("Underwriting_Profit_USD", "Underwriting_Profit").alias("profit"),
        bound(num(df, "Speed_kmh", 0.0), low=0.0).alias("speed"),
        (F.lower(text(df, "Status", "Driving")) != "parked").cast("int").alias("active"),
        num(df, "GPS_Latitude").alias("GPS_Latitude"), num(df, "GPS_Longitude").alias("GPS_Longitude"),
    )
    located = F.col("GPS_Latitude").isNotNull() & F.col("GPS_Longitude").isNotNull()
    out = working.groupBy("City").agg(
        F.countDistinct("Plate").alias("Vehicle_Count"), F.sum("active").alias("Active_Vehicles"),
        F.avg("risk").alias("Avg_Risk_Score"),
        F.avg("usd").alias("Avg_Monthly_Premium_USD"), F.sum("usd").alias("Total_Monthly_Premium_USD"),
        F.avg("zig").alias("Avg_Monthly_Premium_ZIG"), F.sum("zig").alias("Total_Monthly_Premium_ZIG"),
        F.sum("claim").alias("Total_Expected_Claims"), F.sum("profit").alias("Total_Profit"),
        F.avg("speed").alias("Avg_Speed_kmh"),
        F.avg(F.when(located, F.col("GPS_Latitude"))).alias("lat"),
        F.avg(F.when(located, F.col("GPS_Longitude"))).alias("lon"),
    )
    # One row per city is left here, so the fleet total over them is a small window.
    fleet = F.sum("Vehicle_Count").over(Window.partitionBy(F.lit(0)))
    out = out.withColumns({
        "lat": F.coalesce("lat", fixed_centroid(F.col("City"), 0)),
        "lon": F.coalesce("lon", fixed_centroid(F.col("City"), 1)),
        "Risk_Level": risk.band(F.coalesce(F.col("Avg_Risk_Score"), F.lit(0.0))),
        "Vehicle_Share_Pct": F.col("Vehicle_Count") / F.greatest(fleet, F.lit(1)) * F.lit(100.0),
    })
    money = {c: 2 for c in out.schema.names if c.startswith(("Avg_Monthly", "Total_"))}
    out = round_columns(out, {**money, "Avg_Risk_Score": 3, "Avg_Speed_kmh": 1, "Vehicle_Share_Pct": 1,
                              "lat": 5, "lon": 5})
    return out.orderBy(F.desc("Avg_Risk_Score"), F.desc("Total_Monthly_Premium_USD"), F.asc("City"))


def vehicle_share(df: DataFrame, key: str = "City") -> DataFrame:
    """Share of all distinct vehicles per group, against a one-row total."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("Plate").alias("Vehicle_Count"))
    total = counts.agg(F.sum("Vehicle_Count")).scalar()
    return counts.withColumn("Vehicle_Share_Pct", F.col("Vehicle_Count") / total * F.lit(100.0))


def unpivot_row(row: DataFrame, metrics: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of measures to (Metric, Value) rows."""
    cells = F.array(*[F.struct(F.lit(name).alias("Metric"), value.cast("double").alias("Value"))
                      for name, value in metrics])
    return row.select(F.inline(cells))


def portfolio_profitability(df: DataFrame) -> DataFrame:
    """Thirteen metric rows; profit comes from the sums, so it may be negative."""
    def total(name: str) -> Column:
        return _sum(num(df, name)) if has(df, name) else F.lit(0.0)

    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[total(f"{base}_{cur}").alias(f"{alias}_{cur}") for cur in ("USD", "ZIG")
          for base, alias in (("Monthly_Premium", "premium"), ("Expected_Claim", "claim"),
                              ("Underwriting_Expenses", "expense"))])
    c = F.col
    profit = {cur: c(f"premium_{cur}") - c(f"claim_{cur}") - c(f"expense_{cur}") for cur in ("USD", "ZIG")}
    per = lambda v: _share(v, c("n"))
    margin = F.when(c("premium_USD") > 0, profit["USD"] / c("premium_USD") * F.lit(100.0)).otherwise(F.lit(0.0))
    out = unpivot_row(row, [
        ("Total Vehicles", c("n")),
        ("Total Monthly Premium ($)", c("premium_USD")), ("Total Monthly Premium (ZIG)", c("premium_ZIG")),
        ("Total Expected Claims ($)", c("claim_USD")), ("Total Expected Claims (ZIG)", c("claim_ZIG")),
        ("Total Expenses ($)", c("expense_USD")), ("Total Expenses (ZIG)", c("expense_ZIG")),
        ("Total Monthly Profit ($)", profit["USD"]), ("Total Monthly Profit (ZIG)", profit["ZIG"]),
        ("Average Premium per Vehicle ($)", per(c("premium_USD"))),
        ("Average Profit per Vehicle ($)", per(profit["USD"])),
        ("Average Profit per Vehicle (ZIG)", per(profit["ZIG"])),
        ("Profit Margin (%)", margin),
    ])
    return round_columns(out, {"Value": 2})


def premium_kpis(df: DataFrame) -> DataFrame:
    """Premium totals, band counts, behaviour claims and the loss ratio."""
    df = df.withColumn("__premium", num(df, "Monthly_Premium_USD",
                                        None if has(df, "Monthly_Premium_USD") else 50.0))
    band = text(df, "Risk_Band")
    row = df.agg(
        _sum("__premium").alias("total_premium"), F.coalesce(F.avg("__premium"), F.lit(0.0)).alias("avg_premium"),
        count_where(band == "Critical").alias("high_risk_count"),
        count_where(band == "Low").alias("low_risk_count"), _sum(px.behaviour_claim(df)).alias("expected_claims"))
    ratio = F.when(F.col("total_premium") > 0, F.col("expected_claims") / F.col("total_premium")).otherwise(F.lit(0.0))
    return row.withColumns({"median_premium": F.coalesce(_median(df, "__premium"), F.lit(0.0)),
                            "loss_ratio": bound(ratio, 0.0, 2.0)})


def _decision_row(df: DataFrame) -> list[Column]:
    decision, band = text(df, "Decision_Status", "quoted"), text(df, "Risk_Band", "Medium")

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(num(df, name, 0.0)), F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("record_count"),
        count_where(decision == "quoted").alias("quoted_count"),
        count_where(decision == "declined").alias("declined_count"),
        count_where(band.isin("High", "Critical")).alias("high_risk_count"),
        count_where(band == "Critical").alias("critical_risk_count"),
        mean("LightGBM_Risk_Score").alias("avg_model_risk_score"),
        mean("Calculated_Risk_Score").alias("avg_calculated_risk_score"),
        mean("Monthly_Premium_USD").alias("avg_monthly_premium_usd"),
        _sum(num(df, "Monthly_Premium_USD", 0.0)).alias("total_monthly_premium_usd"),
    ]


def live_summary(df: DataFrame) -> DataFrame:
    """Summary row of the live frame."""
    return df.agg(*_decision_row(df))


def bundle_summary(df: DataFrame, source_name: str, trained_model: bool = False) -> DataFrame:
    """Summary row of an analysed portfolio."""
    row = df.agg(*_decision_row(df),
                 _sum(num(df, "Expected_Claim_USD", 0.0)).alias("total_expected_claim_usd"),
                 _sum(num(df, "Underwriting_Profit_USD", 0.0)).alias("total_underwriting_profit_usd"))
    return row.select(F.lit(source_name).alias("source_name"),
                      F.lit(trained_model).alias("trained_models_available"), "*")


def overview_kpis(df: DataFrame) -> DataFrame:
    """Twelve overview KPIs; an absent column takes its stated constant."""
    def mean(name: str, absent: float) -> Column:
        return F.avg(num(df, name)) if has(df, name) else F.max(F.lit(absent))

    def total(name: str) -> Column:
        return _sum(num(df, name)) if has(df, name) else F.max(F.lit(0.0))

    band = text(df, "Risk_Band")
    return df.agg(
        F.count(F.lit(1)).alias("total_vehicles"), mean("Calculated_Risk_Score", 0.5).alias("avg_risk_score"),
        count_where(band.isin("High", "Critical")).alias("high_risk_count"),
        count_where(band == "Low").alias("low_risk_count"),
        total("Monthly_Premium_USD").alias("total_premium"), mean("Monthly_Premium_USD", 0.0).alias("avg_premium"),
        mean("Speed_kmh", 0.0).alias("avg_speed"), mean("Recent_Harsh_Events", 0.0).alias("avg_harsh_events"),
        mean("Fuel_Efficiency_L_per_100km", 8.5).alias("avg_fuel_efficiency"),
        mean("Trip_Distance_km", 0.0).alias("avg_trip_distance"),
        total("Speeding_Flag").cast("long").alias("vehicles_speeding"),
        total("Recent_Harsh_Events").alias("total_harsh_events"))


def live_telemetry_kpis(df: DataFrame) -> DataFrame:
    """Nine live telemetry KPIs."""
    def mean(name: str) -> Column:
        return F.avg(num(df, name)) if has(df, name) else F.max(F.lit(0.0))

    status = text(df, "Status")
    active = (count_where(F.coalesce(status != "Parked", F.lit(True))) if has(df, "Status")
              else F.count(F.lit(1)))
    return df.agg(
        mean("Speed_kmh").alias("avg_speed"), mean("Acceleration_mps2").alias("avg_acceleration"),
        mean("Engine_Load_pct").alias("avg_engine_load"), mean("Battery_V").alias("avg_battery_voltage"),
        mean("Fuel_Efficiency_L_per_100km").alias("avg_fuel_efficiency"),
        count_where(status == "Driving").alias("vehicles_driving"),
        F.coalesce(F.sum(num(df, "Speeding_Flag", 0.0)), F.lit(0.0)).cast("long").alias("speeding_vehicles"),
        count_where(num(df, "Calculated_Risk_Score") > 0.75).alias("high_risk_vehicles"),
        active.alias("current_active_vehicles"))


def action_counts(df: DataFrame) -> DataFrame:
    """Vehicles per policy action; a missing action is a standard offer."""
    return (df.groupBy(text(df, "PPO_Action", "standard_offer").alias("PPO_Action"))
            .agg(F.count(F.lit(1)).alias("Vehicle_Count"))
            .orderBy(F.desc("Vehicle_Count"), F.asc("PPO_Action")))


def value_counts(df: DataFrame, column: str, missing: str | None = None, count: str = "Count") -> DataFrame:
    """Counts per value, most frequent first; NULL is dropped or given a name."""
    value = F.col(column) if missing is None else text(df, column, missing)
    return (df.select(value.alias(column)).groupBy(column).agg(F.count(column).alias(count))
            .filter(F.col(count) > 0).orderBy(F.desc(count), F.asc(column)))


def grouped_rows(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """Group by keys without the NULL groups.

    They are dropped by their count after the aggregate; a filter on a computed key would
    be pushed into the expressions behind it and multiply them.
    """
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    grouped = df.groupBy(*keys).agg(count_where(named).alias("__n"), *measures)
    return grouped.filter("__n > 0").drop("__n")


_AGGREGATES = {"Average": F.avg, "Sum": F.sum, "Min": F.min, "Max": F.max}


def chooser(df: DataFrame, x: str, y: str, how: str = "Average", legend: str | None = None) -> DataFrame:
    """Any measure by one or two chosen columns."""
    keys = [x] + ([legend] if legend and has(df, legend) else [])
    measure = F.count(F.lit(1)).alias("Count") if how == "Count" else _AGGREGATES[how](F.col(y)).alias(y)
    return grouped_rows(df, keys, measure)


def city_distribution(df: DataFrame) -> DataFrame:
    """Mean score and distinct vehicles by city."""
    return (df.filter(F.col("City").isNotNull()).groupBy("City").agg(
        F.avg("Risk_Score").alias("Avg_Risk_Score"), F.countDistinct("Plate").alias("Vehicle_Count"))
        .orderBy(F.desc("Avg_Risk_Score"), F.asc("City")))


def band_city_counts(df: DataFrame) -> DataFrame:
    """Distinct vehicles by band and city."""
    return grouped_rows(df, ["Risk_Band", "City"], F.countDistinct("Plate").alias("Vehicle_Count"))


def status_shares(df: DataFrame) -> DataFrame:
    """Driving and parked counts and percentages."""
    total = F.count(F.lit(1))
    status = text(df, "Status")
    driving, parked = count_where(status == "Driving"), count_where(status == "Parked")
    return df.agg(total.alias("total_vehicles"), driving.alias("driving_count"), parked.alias("parked_count"),
                  (_share(driving, total) * F.lit(100.0)).alias("driving_pct"),
                  (_share(parked, total) * F.lit(100.0)).alias("parked_pct"))


def severity_shares(flagged: DataFrame) -> DataFrame:
    """Count and share of all four severity levels, including empty ones."""
    total = F.count(F.lit(1))
    row = flagged.agg(total.alias("total"), *[
        count_where(F.col("Severity") == b).alias(b) for b in K.BANDS])
    cells = F.array(*[F.struct(F.lit(b).alias("Severity"), F.col(b).alias("Count"),
                               (_share(F.col(b), F.col("total")) * F.lit(100.0)).alias("Pct"))
                      for b in reversed(K.BANDS)])
    return row.select(F.inline(cells))


def geospatial_headline(city_table: DataFrame) -> DataFrame:
    """City count, mean of the city means, hotspot and most profitable city."""
    rank = F.struct("Avg_Risk_Score", "Total_Monthly_Premium_USD")
    return city_table.agg(
        F.count(F.lit(1)).alias("active_cities"), F.avg("Avg_Risk_Score").alias("avg_city_risk"),
        F.max_by("City", rank).alias("top_risk_city"), F.max("Avg_Risk_Score").alias("top_risk_score"),
        F.max_by("City", "Total_Profit").alias("top_profit_city"), F.max("Total_Profit").alias("top_profit"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint of a table: row count and two combined row hashes.

    The sum keeps repeated rows from cancelling out, as they would under ``xor`` alone.
    """
    row = F.xxhash64(*df.schema.names)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.schema.names)).alias("column_count"),
                  F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash_xor"),
                  F.coalesce(F.sum(F.pmod(row, F.lit(2147483647))), F.lit(0)).alias("hash_sum"))

