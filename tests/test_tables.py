"""Queries against their SQL twins, invariance under partitioning, plans and whole pipelines."""

from __future__ import annotations

import json
import random
import statistics as statistics_module
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetrisk.functions.distributions import chi2_tail, kolmogorov_tail, normal_two_sided, t_two_sided
from fleetrisk.operators import drivers, joins, modeling, ranks, rollups, scoring, statistics
from fleetrisk.plans import training
from fleetrisk.plans.portfolio import analyse_portfolio
from fleetrisk.sources import io, testdata
from tests.compare import connect, difference
from tests.conftest import SF_SMALL

AS_OF = datetime(2024, 2, 1)
TWINS = ("C1_portfolio_clean", "C24_preprocess", "R19_live_outputs", "P9_quote", "P12_premium_schedule", "J1_live_overlay",
         "G4_city_summary", "G9_city_analytics", "G18_behaviour_by_type", "G26_histogram", "G1_driver_statistics",
         "W5_rolling_speed", "W7_trip_sessions", "A9_sticky_severity", "M14_mann_whitney", "M15_chi_square", "M16_spearman",
         "T3_speed_windows", "T7_running_counters")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.mark.parametrize("key", TWINS)
def test_twin(spark, duck, key):
    assert difference(entry.queries()[key](spark, SF_SMALL), duck, entry.oracle_sql()[key]) is None


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_crowded_values_beside_an_outlier_are_cut_again(spark):
    df = spark.range(100_000).select((F.lit(100.0) + F.col("id") / 100_000).alias("v")).union(spark.sql("SELECT 1e12D AS v"))
    counts = df.groupBy("v").count()
    cut = ranks._cut_again(ranks._with_buckets(counts, df, "v"), "v", [])
    largest = cut.groupBy(*ranks._BUCKET).count().agg(F.max("count")).first()[0]
    assert largest <= 1.1 * ranks.BUCKET_ROWS
    got = ranks.grouped_quantiles(df, "v", {"a": 0.25, "b": 0.5}).first()
    assert (got["a"], got["b"]) == (pytest.approx(100.25), pytest.approx(100.5))


def test_quantiles_on_a_hot_value(spark):
    random.seed(1)
    values = [5.0] * 400 + [random.gauss(0, 1e3) for _ in range(300)] + [1e12, -1e12] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.grouped_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    held = sorted(v for v in values if v is not None)
    for alias, p in (("a", 0.1), ("b", 0.5), ("c", 0.95)):
        at = p * (len(held) - 1)
        lo = int(at)
        assert got[alias] == pytest.approx(held[lo] + (held[min(lo + 1, len(held) - 1)] - held[lo]) * (at - lo), rel=1e-12)


def _history(spark, n=260):
    random.seed(3)
    start = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"V{i % 7}", start + timedelta(minutes=37 * random.randrange(2000)),
             float(random.randrange(0, 200)), random.choice(["Driving", "Parked"]), random.randrange(4), float(random.randrange(50)))
            for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, Plate string, Last_Update timestamp_ntz, Speed_kmh double, Status string, "
                                       "Harsh_Brake_Count int, Trip_Distance_km double").withColumn("City", F.lit(None).cast("string"))


def test_partitioning_does_not_matter(spark):
    df = _history(spark)
    for build in (lambda d: drivers.driver_statistics(d, tiebreak=["event_id"], lookback=40),
                  lambda d: drivers.driver_statistics(d, tiebreak=["event_id"], lookback=None),
                  lambda d: drivers.rolling_speed(d, "event_id"), lambda d: drivers.trip_sessions(d, tiebreak=["event_id"])):
        results = [sorted(map(str, build(x).collect())) for x in (df.repartition(1), df.repartition(17).orderBy(F.rand(2)))]
        assert results[0] == results[1]


def test_lookback_counts_the_first_kept_row_in_full(spark):
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=i), float(i)) for i in range(121)]
    rows += [("b", datetime(2024, 1, 1), 7.0), ("b", datetime(2024, 1, 2), 3.0), ("b", None, 99.0)]
    df = spark.createDataFrame(rows, "Plate string, Last_Update timestamp_ntz, Trip_Distance_km double")
    got = {r["Plate"]: r for r in drivers.driver_statistics(df).collect()}
    assert got["a"]["observation_count"] == 120 and got["a"]["trip_distance_km"] == 120.0
    assert got["b"]["trip_distance_km"] == 7.0 and got["b"]["observation_count"] == 2
    assert got["b"]["latest_city"] is None and got["a"]["speed_std_kmh"] == 0.0


def test_trailing_window_against_brute_force(spark):
    df = _history(spark)
    rows = df.collect()
    got = {r["event_id"]: r["Avg_Speed_Last_7_Days"] for r in drivers.rolling_speed(df, "event_id").collect()}
    for row in rows:
        near = [x["Speed_kmh"] for x in rows if x["Plate"] == row["Plate"]
                and row["Last_Update"] - timedelta(days=7) <= x["Last_Update"] <= row["Last_Update"]]
        assert got[row["event_id"]] == pytest.approx(sum(near) / len(near), rel=1e-12)


def test_a_vehicle_with_most_rows_of_an_hour(spark):
    """Blocks cut into parts give what whole blocks give, also where rows share an instant."""
    start, rng = datetime(2024, 1, 1), random.Random(4)
    rows = [(k, "hot" if k % 4 else f"V{k % 3}", start + timedelta(seconds=rng.choice((rng.randrange(3600), 1800, rng.randrange(8 * 86400)))),
             float(rng.randrange(0, 200)) / 4, rng.choice(["Driving", "Driving", "Parked", None]), float(rng.randrange(-40, 40)) / 8, float(rng.randrange(500)))
            for k in range(2500)]
    df = spark.createDataFrame(rows, "event_id long, Plate string, Last_Update timestamp_ntz, Speed_kmh double, Status string, "
                                     "Acceleration_mps2 double, Trip_Distance_km double").repartition(4)

    def rounded(out):
        return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in out.collect())

    for build in (lambda n: drivers.trip_sessions(df, tiebreak=["event_id"], block_rows=n),
                  lambda n: drivers.trailing_extremes(df, "event_id", 7, block_rows=n),
                  lambda n: drivers.with_previous(df, "Plate", "Last_Update", ["Speed_kmh"], ["event_id"], block_rows=n).drop("__block")):
        assert rounded(build(40)) == rounded(build(10**6))
    parts = drivers._blocked(df, "Plate", "Last_Update", drivers.DAY, 40).groupBy("Plate", "__block").count()
    instants = Counter((r[1], r[2]) for r in rows)
    assert parts.agg({"count": "max"}).first()[0] <= max(40, max(instants.values()))
    got = {r["event_id"]: r for r in drivers.trailing_extremes(df, "event_id", 7, block_rows=40).collect()}
    for row in rows[:60]:
        near = [x for x in rows if x[1] == row[1] and row[2] - timedelta(days=7) <= x[2] <= row[2]]
        speeds = [x[3] for x in near]
        assert got[row[0]]["Max_Speed_kmh"] == max(speeds)
        assert got[row[0]]["Speed_Variance"] == pytest.approx(statistics_module.variance(speeds) if len(speeds) > 1 else 0.0, rel=1e-9, abs=1e-9)
        assert got[row[0]]["Max_Deceleration_mps2"] == max(0.0, *[-x[5] for x in near])


def test_variance_of_large_speeds(spark):
    rows = [(k, "a", datetime(2024, 1, 1) + timedelta(minutes=k), 1e9 + k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id long, Plate string, Last_Update timestamp_ntz, Speed_kmh double")
    last = drivers.trailing_extremes(df.withColumn("Acceleration_mps2", F.lit(0.0)), "event_id").where("event_id = 29").first()
    assert last["Speed_Variance"] == pytest.approx(statistics_module.variance([k % 3 for k in range(30)]), rel=1e-12)


def test_trip_plan_has_few_shuffles(spark):
    text = _exchanges(drivers.trip_sessions(testdata.history(spark, SF_SMALL), tiebreak=["event_id"]))
    assert text.count("Exchange hashpartitioning") <= 6 and "SinglePartition" not in text


def test_modal_band_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("X", "a", "Low", 0.1), ("X", "b", "High", 0.6)],
                               "City string, Plate string, Risk_Band string, Calculated_Risk_Score double")
    assert rollups.city_summary(df).first()["Risk_Band"] == "High"


def test_tail_probabilities():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(2.0, 10) == pytest.approx(0.9963401531726563, rel=1e-9)
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-8)
    assert t_two_sided(0.5, 10) == pytest.approx(0.6278936, rel=1e-5)
    assert kolmogorov_tail(1.3580986 / 10, 200, 200) == pytest.approx(0.05, rel=1e-4)


def test_small_groups_give_error_rows(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (0, 3.0, "a"), (0, 4.0, "a")], "Risk_Label int, x double, c string")
    assert statistics.mann_whitney(df, ["x"]).first()["error"] == "insufficient_group_data"
    assert statistics.chi_square(df, ["c"]).first()["error"] == "insufficient_levels"


def test_yates_on_two_by_two(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 15
    got = statistics.chi_square(spark.createDataFrame(rows, "c string, Risk_Label int"), ["c"]).first()
    n, ad_bc = 75, abs(10 * 15 - 20 * 30)
    assert got["chi2"] == pytest.approx(n * (ad_bc - n / 2) ** 2 / (30 * 45 * 40 * 35), rel=1e-12)
    assert got["dof"] == 1 and 0 < got["p_value"] < 0.05


def _exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_distributed(spark):
    history = testdata.history(spark, SF_SMALL)
    plan = _exchanges(drivers.driver_statistics(history, tiebreak=["event_id"]))
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    sums = ranks.prefix_sums(history, "Speed_kmh", {"n": F.lit(1)}, ["City"])
    assert "BroadcastNestedLoopJoin" not in _exchanges(sums) and "CartesianProduct" not in _exchanges(sums)
    scan = _exchanges(rollups.value_counts(history, "Status"))
    assert "ReadSchema: struct<event_type:string>" in scan


def test_bundle_and_sinks(spark, tmp_path):
    bundle = analyse_portfolio(testdata.portfolio(spark, SF_SMALL), AS_OF, plates_known=True)
    n = bundle["analysis"].count()
    assert bundle["summary"].first()["record_count"] == n == bundle["premium_schedule"].count()
    assert sum(r["Vehicle_Count"] for r in bundle["action_summary"].collect()) == n
    io.write_csv(bundle["premium_schedule"], str(tmp_path / "schedule.csv"))
    back = io.load_portfolio(spark, str(tmp_path / "schedule.csv"))
    assert back.count() == n and back.schema["Risk_Score"].dataType.simpleString() == "double"
    io.write_json_row(bundle["summary"], str(tmp_path / "summary.json"))
    assert io.read_json_row(spark, str(tmp_path / "summary.json"))["record_count"] == n
    assert io.read_json_row(spark, str(tmp_path / "none.json")) is None
    bundle["analysis"].unpersist()
    with pytest.raises(ValueError):
        io.load_portfolio(spark, "book.xlsx")
    (tmp_path / "records.json").write_text("\n".join(json.dumps({"Plate": f"V{i}", "Type": "Van"}) for i in range(3)))
    assert io.read_records(spark, str(tmp_path / "records.json")).count() == 3


def test_state_table_replaces_whole_versions(spark, tmp_path):
    table = io.StateTable(spark, str(tmp_path / "state"))
    assert table.read() is None
    table.replace(spark.createDataFrame([("a", 1)], "plate string, n int"))
    old = table.read()
    table.replace(old.withColumn("n", F.col("n") + 1))
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]


def test_two_writers_do_not_lose_an_update(spark, tmp_path):
    path = str(tmp_path / "state")
    one, two = io.StateTable(spark, path), io.StateTable(spark, path)
    start = spark.createDataFrame([("a", 1)], "plate string, n int")
    assert one.replace(start) == 1
    mine, theirs = one.read(), two.read()
    assert one.replace(mine.withColumn("n", F.col("n") + 1)) == 2
    with pytest.raises(io.StateConflict):
        two.replace(theirs.withColumn("n", F.col("n") + 10))
    assert two.replace(two.read().withColumn("n", F.col("n") + 10)) == 3
    assert [tuple(r) for r in one.read().collect()] == [("a", 12)]
    (tmp_path / "state" / "current" / f"{4:012d}").write_bytes(b"")  # a writer that ended between its two steps
    assert [tuple(r) for r in one.read().collect()] == [("a", 12)]
    assert one.replace(one.read().withColumn("n", F.col("n") * 2), keep=1) == 5
    assert [tuple(r) for r in two.read().collect()] == [("a", 24)]
    assert len(list((tmp_path / "state").glob("version=*"))) == 1


def test_schedule_of_repeated_plates_shows_the_last_row(spark):
    df = testdata.portfolio(spark, SF_SMALL).limit(30)
    twice = df.unionByName(df.withColumn("Make", F.lit("Later")).withColumn("c_custkey", F.col("c_custkey") + 10**6))
    from fleetrisk.operators import pricing
    shown = pricing.premium_schedule(twice, order=["c_custkey"])
    assert shown.count() == 60 and {r["Make"] for r in shown.collect()} == {"Later"}
    assert {r["Make"] for r in pricing.premium_schedule(twice, unique_plates=True).collect()} != {"Later"}


def test_failed_reads_are_errors(spark, tmp_path):
    (tmp_path / "current").mkdir()
    (tmp_path / "current" / "part-0.parquet").write_text("no parquet file")
    with pytest.raises(Exception):
        io.StateTable(spark, str(tmp_path)).read()


def test_repeated_keys_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("a", "Driving", 1.0), ("b", "Driving", 2.0), (None, "Parked", 3.0)], "Plate string, Status string, Risk_Score double")
    twice = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("a", None), (None, 9.0)], "Plate string, Risk_Score double")
    expected = {("a", 7.0), ("b", 2.0), (None, 3.0)}
    for result in (joins.update_while_driving(df, twice), joins.overlay(df, twice, ["Risk_Score"])):
        rows = result.select("Plate", "Risk_Score").collect()
        assert len(rows) == 3 and {tuple(r) for r in rows} == expected


def test_cache_without_a_match_is_no_cache(spark):
    df = testdata.portfolio(spark, SF_SMALL)
    cached = spark.createDataFrame([("unknown plate", 0.9)], "Plate string, LightGBM_Risk_Score double")
    plain = scoring.explainable_scores(df).select("Plate", "Risk_Score", "Risk_Band")
    scored = scoring.ensure_model_scores(df, cached=cached).select("Plate", "Risk_Score", "Risk_Band")
    assert scored.exceptAll(plain).isEmpty() and plain.exceptAll(scored).isEmpty()
    fixed = scoring.ensure_model_scores(df, cached, lambda d: d.withColumn("LightGBM_Risk_Score", F.lit(0.25)))
    assert fixed.where("LightGBM_Risk_Score <> 0.25 OR LightGBM_Risk_Score IS NULL").isEmpty()


def test_any_number_of_levels(spark):
    df = spark.range(300).select(F.concat(F.lit("road "), "id").alias("Road_Type"), F.col("id").cast("double").alias("score"))
    assert len(modeling.fit_features(df).features) == 300


def test_encoder_is_fitted_once_and_model_round_trips(spark, tmp_path):
    rows = [(f"V{i}", ["Urban", "Gravel", None][i % 3], ["x", "y"][i % 2], float(i % 10), int(i % 10 > 4), datetime(2024, 1, 1) + timedelta(hours=i))
            for i in range(200)]
    df = spark.createDataFrame(rows, "Plate string, Road_Type string, Kind string, score double, Risk_Label int, Last_Update timestamp")
    encoder = modeling.fit_features(df)
    assert encoder.features == ["score", "Kind", "Road_Type_Urban"]
    later = encoder.transform(df.filter("Road_Type = 'Urban' AND Kind = 'y'"))
    assert {(r["Kind"], r["Road_Type_Urban"]) for r in later.collect()} == {(1.0, 1.0)}
    train, test = modeling.time_split(encoder.transform(df), 0.2)
    assert (train.count(), test.count()) == (160, 40)
    model = modeling.fit_risk_model(train.select("Risk_Label", "features"), rounds=3)
    modeling.save_model(model, str(tmp_path / "model"))
    scored = modeling.score_features(modeling.load_model(str(tmp_path / "model")), test)
    assert statistics.classification_metrics(scored, "Predicted_Risk_Score", "Risk_Label").first()["roc_auc"] == 1.0
    importance = modeling.permutation_importance(model, test, encoder.features).collect()
    assert importance[0]["feature"] == "score" and importance[0]["importance"] > 0.1


def test_training_rows_of_one_task_are_spread(spark, monkeypatch):
    """The booster's many passes share the rows among tasks, also where one task read the whole history."""
    class Seen(Exception):
        pass

    def fit(train, **options):
        raise Seen([n for n in train.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n])

    monkeypatch.setattr(training, "FILE_ROWS", 100, raising=False)
    monkeypatch.setattr(modeling, "fit_risk_model", fit)
    history = testdata.history(spark, SF_SMALL).coalesce(1)
    with pytest.raises(Seen) as seen:
        training.train(history, rounds=2)
    sizes = seen.value.args[0]
    assert len(sizes) >= 4 and max(sizes) <= 200
    assert sum(sizes) == pytest.approx(0.64 * history.where("Status = 'Driving'").count(), rel=0.02)


def test_many_levels_are_numbered_in_order(spark):
    """Codes are the places in code point order; no column per level is made."""
    words = sorted({"".join(chr(c) for c in random.Random(k).choices(range(33, 900), k=4)) for k in range(20_000)})
    df = spark.createDataFrame([(w, k % 2 == 0, ["Urban", "Gravel", None][k % 3]) for k, w in enumerate(words)] + [(None, None, "Urban")],
                               "Kind string, Hot boolean, Road_Type string").repartition(5)
    encoder = modeling.fit_features(df)
    assert encoder.numeric == ["Hot"] and encoder.size == 3
    place = {w: float(k) for k, w in enumerate(sorted([*words, "missing"]))}
    later = spark.createDataFrame([(w, True, "Gravel") for w in words[::1000]] + [(None, False, "Urban"), ("never seen", None, "never seen")],
                                  "Kind string, Hot boolean, Road_Type string")
    rows = encoder.transform(later.withColumn("was", F.col("Kind")), show_dummies=False).collect()
    assert all(r["Kind"] == place.get(r["was"] or "missing", float(len(place))) for r in rows) and len(rows) == 22
    hot = {(r["was"] == "never seen" or r["was"] is None): list(r["features"].toArray()) for r in rows}
    assert hot[False][0] == 1.0 and hot[False][2] == 0.0 and {r["features"].toArray()[2] for r in rows} == {0.0, 1.0}
    names = {r["position"]: r["feature"] for r in encoder.names(spark).collect()}
    assert [names[k] for k in range(3)] == encoder.features == ["Hot", "Kind", "Road_Type_Urban"]


def test_logistic_fit_meets_its_bound(spark):
    from pyspark.ml.functions import array_to_vector
    rng, rows = random.Random(8), []
    for k in range(4000):
        x, z = rng.gauss(0, 1), rng.gauss(5e5, 1e3)  # one feature large and of little spread
        rows.append(([x, z, 1.0, 2 * x + rng.gauss(0, 0.1)], int(rng.random() < 1 / (1 + 2.718281828 ** -(0.7 + 1.5 * x - 0.002 * (z - 5e5))))))
    df = spark.createDataFrame(rows, "x array<double>, Risk_Label int").select("Risk_Label", array_to_vector("x").alias("features"))
    fitted = modeling.fit_logistic(df)
    assert fitted.gradient <= 1e-6 and fitted.coefficients[2] == 0.0
    assert fitted.coefficients[0] + 2 * fitted.coefficients[3] == pytest.approx(1.5, abs=0.2) and fitted.coefficients[1] == pytest.approx(-0.002, abs=3e-4)
    mean, shown = df.agg(F.avg("Risk_Label"), F.avg(fitted.probability())).first()
    assert mean == pytest.approx(shown, abs=1e-5)
    with pytest.raises(modeling.NotConverged):
        modeling.fit_logistic(df, steps=1)
    table = modeling.odds_ratios(df, ["a", "b", "c", "d"], n=2).collect()
    assert len(table) == 2 and table[0]["odds_ratio"] == pytest.approx(2.718281828459045 ** table[0]["coef"])


def test_empty_cells_leave_the_ratios_empty(spark):
    df = testdata.history(spark, SF_SMALL).withColumn("RPM", F.when(F.col("event_id") % 2 == 0, F.col("RPM")))
    rows = statistics.synthesize_targets(df)
    assert rows.where("event_id % 2 = 1 AND (RPM_per_Speed IS NOT NULL OR Load_per_RPM IS NOT NULL)").isEmpty()
    assert rows.where("event_id % 2 = 0 AND RPM_per_Speed IS NULL").isEmpty()


def test_every_csv_line_is_read_or_rejected(spark, tmp_path):
    (tmp_path / "book.csv").write_text("Plate,Speed,_rejected\nV1,1.5,x\nV2,fast,x\nV3,2\nV4,3,x,more\n,,\nV5,4,\n")
    good, bad = io.read_csv_checked(spark, str(tmp_path / "book.csv"), "Plate string, Speed double, _rejected string")
    assert {(r[0], r[1]) for r in good.collect()} == {("V1", 1.5), (None, None), ("V5", 4.0)} and good.columns == ["Plate", "Speed", "_rejected"]
    assert {r["line"] for r in bad.collect()} == {"V2,fast,x", "V3,2", "V4,3,x,more"}
