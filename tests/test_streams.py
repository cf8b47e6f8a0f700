"""Streams: the same rows in one or many batches, late rows, and restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetrisk.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = ("Plate string, Last_Update timestamp, Speed_kmh double, Status string, Harsh_Brake_Count int, "
          "Trip_Distance_km double, Calculated_Risk_Score double, Candidate_Severity string, Composite_Score double")


def _rows(minutes):
    return [(f"V{m % 3}", START + timedelta(minutes=m), float(m % 90), "Driving", m % 5, float(m % 40), (m % 10) / 10,
             ("Low", "High", "Critical")[m % 3], (m % 10) / 10) for m in minutes]


def _feed(spark, folder, minutes):
    spark.createDataFrame(_rows(minutes), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def _drain(spark, folder, build, mode="append"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = (build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True)
             .foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(folder / "out"))))
    query.start().awaitTermination()
    return spark.read.parquet(str(folder / "out"))


@pytest.mark.parametrize("build, mode", [
    (live.running_counters, "update"), (live.smoothed_scores, "append"), (live.sticky_severities, "append"),
    (lambda s: live.latest_snapshot(s), "update")])
def test_batches_and_restarts_do_not_matter(spark, tmp_path, build, mode):
    (tmp_path / "one").mkdir(), (tmp_path / "many").mkdir()
    _feed(spark, tmp_path / "one", range(60))
    whole = _drain(spark, tmp_path / "one", build, mode)
    for part in (range(0, 20), range(20, 40), range(40, 60)):
        _feed(spark, tmp_path / "many", part)
        split = _drain(spark, tmp_path / "many", build, mode)  # each call restarts from the checkpoint

    def final(df):
        if mode == "append":
            return sorted(map(str, df.drop("batch").collect()))
        last = df.groupBy("Plate").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("Plate", "batch")]), "batch").alias("r"))
        return sorted(map(str, last.collect()))

    assert final(whole) == final(split)


def test_late_rows_are_dropped_and_repeats_removed(spark, tmp_path):
    _feed(spark, tmp_path, range(0, 200))
    _drain(spark, tmp_path, live.speed_windows)
    _feed(spark, tmp_path, [3, 400])
    rows = {r["window_start"]: r["observations"] for r in _drain(spark, tmp_path, live.speed_windows).collect()}
    assert rows[START] == 30
    (tmp_path / "again").mkdir()
    _feed(spark, tmp_path / "again", [1, 2, 2, 3])
    assert _drain(spark, tmp_path / "again", live.captured_history).count() == 3


def test_scored_stream_and_error_report(spark, tmp_path):
    _feed(spark, tmp_path, range(10))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    errors = []

    def fail(batch, i):
        raise RuntimeError("sink down")

    query = live.periodic_scores(stream, fail, str(tmp_path / "ck2"), on_error=lambda i, e: errors.append(str(e)))
    query.trigger(availableNow=True).start().awaitTermination()
    assert errors == ["sink down"]


def _feed_rows(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def _row(minute, plate="V0", score=0.5, level="Low", harsh=0):
    return (plate, START + timedelta(minutes=minute), 0.0, "Driving", harsh, 0.0, score, level, score)


def test_late_rows_take_their_turn_or_are_dropped(spark, tmp_path):
    """Out of order within the watermark's delay: in time order. Behind the watermark: dropped."""
    _feed_rows(spark, tmp_path, [_row(0, score=0.10), _row(30, score=0.90)])
    _drain(spark, tmp_path, live.smoothed_scores)
    _feed_rows(spark, tmp_path, [_row(25, score=0.0), _row(2, score=0.99), _row(60, score=0.90)])
    _drain(spark, tmp_path, live.smoothed_scores)
    _feed_rows(spark, tmp_path, [_row(90)])
    out = _drain(spark, tmp_path, live.smoothed_scores).orderBy("Last_Update").collect()
    assert [(r["Last_Update"], round(r["Calculated_Risk_Score"], 6)) for r in out] == [
        (START, 0.1), (START + timedelta(minutes=25), 0.08), (START + timedelta(minutes=30), 0.1), (START + timedelta(minutes=60), 0.12)]


def test_counters_are_corrected_by_rows_that_come_between(spark, tmp_path):
    _feed_rows(spark, tmp_path, [_row(0, harsh=1), _row(20, harsh=9)])
    first = _drain(spark, tmp_path, live.running_counters, "update").collect()
    assert [r["harsh_event_total"] for r in first] == [9.0]
    _feed_rows(spark, tmp_path, [_row(15, harsh=12), _row(3, harsh=500)])  # 1, 12, 9: grows by 11, then none; minute 3 is late
    last = _last(_drain(spark, tmp_path, live.running_counters, "update"))
    assert (last["harsh_event_total"], last["observation_count"]) == (12.0, 3)


def _last(rows):
    return rows.orderBy(F.desc("batch")).first()


def test_a_hold_ends_by_the_clock(spark, tmp_path):
    """The other vehicle's rows move the watermark; the first one sends nothing more."""
    _feed_rows(spark, tmp_path, [_row(0, level="Low"), _row(60, level="Critical"), _row(1, "V1", level="Medium")])
    _drain(spark, tmp_path, live.sticky_severities)
    _feed_rows(spark, tmp_path, [_row(14 * 60, "V1", level="High")])
    _drain(spark, tmp_path, live.sticky_severities)
    _feed_rows(spark, tmp_path, [_row(15 * 60, "V1", level="High")])
    out = _drain(spark, tmp_path, live.sticky_severities)
    mine = [(r["Last_Update"], r["Severity"], r["Hold_Over"]) for r in out.where("Plate = 'V0'").orderBy("Last_Update").collect()]
    assert mine == [(START, "Low", False), (START + timedelta(minutes=60), "Low", False), (START + timedelta(hours=12), "Low", True)]
    assert out.where("Plate = 'V1' AND Hold_Over").count() == 0


def test_one_vehicle_with_most_rows(spark, tmp_path):
    rows = [_row(k / 10, "V0" if k % 3 else f"V{k % 7}", (k % 10) / 10) for k in range(3000)]
    _feed_rows(spark, tmp_path, rows)
    out = _drain(spark, tmp_path, live.smoothed_scores)
    closed = [r for r in rows if r[1] <= rows[-1][1] - timedelta(minutes=10)]
    assert out.count() == len(closed)
    shown = {}
    for plate, at, *_, score, _, _ in closed:
        before = shown.get(plate)
        shown[plate] = score if before is None else min(max(before + min(max(score - before, -0.02), 0.02), 0.0), 1.0)
    got = {r["Plate"]: r["r"] for r in out.groupBy("Plate").agg(F.max_by("Calculated_Risk_Score", "Last_Update").alias("r")).collect()}
    assert got == pytest.approx(shown)


def test_a_failed_sink_loses_nothing_and_doubles_nothing(spark, tmp_path):
    for part in (range(0, 10), range(10, 20), range(20, 30)):
        _feed(spark, tmp_path, part)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink, errors, broken = str(tmp_path / "sink"), [], {1}

    def write(batch, i):
        batch.select("Plate", "Last_Update").write.mode("overwrite").parquet(f"{sink}/batch={i}")
        if i in broken:
            raise RuntimeError("sink down")  # after it has written: the replay must not double these rows

    query = live.periodic_scores(stream, write, str(tmp_path / "ck"), on_error=lambda i, e: errors.append(i))
    query.trigger(availableNow=True).start().awaitTermination()
    assert errors == [1]
    broken.clear()
    assert live.replay_failed(spark, f"{tmp_path}/ck-failed", write) == [1]
    assert live.replay_failed(spark, f"{tmp_path}/ck-failed", write) == []
    assert live.replay_failed(spark, str(tmp_path / "nothing"), write) == []
    rows = spark.read.parquet(sink)
    assert rows.count() == 30 == rows.select("Plate", "Last_Update").distinct().count()


def test_latest_snapshot_settles_ties_by_value(spark, tmp_path):
    _feed_rows(spark, tmp_path, [_row(5, score=s) for s in (0.2, 0.9, 0.4)] + [_row(3, score=1.0)])
    out = _drain(spark, tmp_path, live.latest_snapshot, "update").collect()
    assert [r["Calculated_Risk_Score"] for r in out] == [0.9]
