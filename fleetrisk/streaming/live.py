"""Live results on Structured Streaming.

The stateless ones reuse the batch expressions. Fallbacks that depend on a whole column
do not exist on a stream: a column that is present counts as filled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from fleetrisk import constants as K
from fleetrisk.functions.columns import Presence, num, text
from fleetrisk.operators.features import FEATURE_FALLBACKS
from fleetrisk.operators.filters import fresh_rows
from fleetrisk.operators.pricing import apply_policy
from fleetrisk.operators.scoring import live_risk_outputs

# The state functions go to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score_stream(events: DataFrame) -> DataFrame:
    """Live scores and policy fields of a telemetry stream; stateless, so any output mode works."""
    return apply_policy(live_risk_outputs(events, Presence(events, FEATURE_FALLBACKS, known=True)))


def periodic_scores(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                    every: str = "15 seconds", on_error: Callable[[int, Exception], None] | None = None,
                    failed: str | None = None) -> DataStreamWriter:
    """Re-score each micro-batch and hand it to ``write``; a failed batch is kept and reported, not fatal.

    A batch that ``write`` fails on is stored whole under its number in the table ``failed`` (beside
    the checkpoint where none is named) before the stream goes on; ``replay_failed`` hands it out
    again. If storing fails, too, the query stops, and a restart repeats the batch. Without
    ``on_error`` a failure stops the query at once.
    """
    letters = failed or f"{checkpoint.rstrip('/')}-failed"

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            write(batch, batch_id)
        except Exception as error:
            if on_error is None:
                raise
            batch.write.mode("overwrite").parquet(f"{letters}/rows/batch={batch_id}")
            on_error(batch_id, error)

    return (score_stream(events).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(processingTime=every))


def replay_failed(spark: SparkSession, failed: str, write: Callable[[DataFrame, int], None]) -> list[int]:
    """Hands every stored batch that was not replayed yet to ``write``, in order, and returns their numbers.

    A batch is marked after ``write`` returns. If the job ends between the two, the batch is handed
    out again under its number, so ``write`` must take a number twice without doubling rows, as any
    ``foreachBatch`` sink has to. Batches ``write`` fails on again stay stored.
    """
    def numbers(part: str) -> set[int]:
        try:
            return {r.batch for r in spark.read.parquet(f"{failed}/{part}").select("batch").distinct().collect()}
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return set()
            raise

    done = []
    for number in sorted(numbers("rows") - numbers("replayed")):
        write(spark.read.parquet(f"{failed}/rows/batch={number}"), number)
        spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{failed}/replayed")
        done.append(number)
    return done


def latest_snapshot(events: DataFrame, ts: str = "Last_Update", key: str = "Plate") -> DataFrame:
    """The latest row per vehicle (update or complete mode); of several at one time the greatest."""
    columns = [ts, *[c for c in events.columns if c not in (key, ts)]]
    known = F.when(F.col(ts).isNotNull(), F.struct(*columns))
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.coalesce(F.max(known), F.max(F.struct(*columns))).alias("row")).select(key, *[f"row.{c}" for c in rest])


def versioned_snapshot(events: DataFrame, write: Callable[[DataFrame], None], checkpoint: str,
                       ts: str = "Last_Update") -> DataStreamWriter:
    """Changed snapshot rows per micro-batch, with the batch id as version."""
    return (latest_snapshot(events, ts).writeStream.outputMode("update")
            .foreachBatch(lambda batch, i: write(batch.withColumn("Snapshot_Version", F.lit(i).cast("long"))))
            .option("checkpointLocation", checkpoint))


def speed_windows(events: DataFrame, width: str = "30 minutes", late: str = "10 minutes",
                  ts: str = "Last_Update") -> DataFrame:
    """Tumbling mean speed; rows later than the watermark are dropped."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, width))
            .agg(F.avg(num(events, "Speed_kmh")).alias("Speed_kmh"), F.count(F.lit(1)).alias("observations"))
            .select(F.col("window.start").alias("window_start"), "Speed_kmh", "observations"))


def captured_history(events: DataFrame, late: str = "10 minutes", ts: str = "Last_Update",
                     key: str = "Plate") -> DataFrame:
    """T4: history rows for an append sink, each vehicle and time once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, ts])


def trip_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes",
                 ts: str = "Last_Update", key: str = "Plate") -> DataFrame:
    """Driving sessions per vehicle, closed by a gap without driving rows."""
    rows = events.withWatermark(ts, late).filter(text(events, "Status") == "Driving")
    return (rows.groupBy(key, F.session_window(ts, gap))
            .agg(F.count(F.lit(1)).alias("observations"), F.avg(num(rows, "Speed_kmh")).alias("avg_speed_kmh"))
            .select(key, F.col("session_window.start").alias("trip_start"),
                    F.col("session_window.end").alias("trip_end"), "observations", "avg_speed_kmh"))


def fresh_results(results: DataFrame, as_of: datetime, max_age_seconds: float, ts: str = "Last_Update") -> DataFrame:
    """Rows of a result table that are recent enough to show."""
    return fresh_rows(results, as_of, max_age_seconds, ts)


# --- stateful operators: one small state row per vehicle ---------------------

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Takes the rows of a vehicle in event-time order, whatever batches they come in.

    One rule for late rows: a row at or before the watermark is dropped; every other row waits
    in the state until the watermark has passed it, and then takes its turn. So the result does
    not depend on how the input was cut into batches. The state holds the rows of the watermark's
    delay and one small row per vehicle. Rows of one time go by their values.
    """

    #: Columns of a waiting row after its time in microseconds, and of the state.
    waiting_type: str
    state_type: str
    #: Names of the shown columns, the key first.
    shown: list[str]

    def shown_row(self, key: tuple, values: tuple) -> Row:
        return Row(**dict(zip(self.shown, (*key, *values))))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.waiting_type}")
        self.state = handle.getValueState("state", self.state_type)
        self.columns = ["at", *[part.split()[0] for part in self.waiting_type.split(",")]]

    def take(self, state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        """The state after a row, and what the row shows."""
        raise NotImplementedError

    def pass_time(self, state: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        """The state after time has passed up to ``until`` without a row, and what that shows."""
        return state, []

    def next_call(self, state: tuple | None) -> int | None:
        """When time itself changes the state next, in microseconds."""
        return None

    def _state(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def _rows(self) -> list[tuple]:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return sorted(rows, key=lambda row: [(v is not None, v) for v in row])

    def _call_at(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [tuple(row[c] for c in self.columns) for row in rows if row["at"] > passed]
        if new:
            self.waiting.appendList(new)
            self._call_at(min(row[0] for row in new))
            yield from self.show(key)

    def show(self, key) -> Iterator[Row]:
        """What new rows show before their turn."""
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows, state = self._rows(), self._state()
        due = [row for row in rows if row[0] <= passed]
        before, out = state, []
        for row in due:
            state, shown = self.pass_time(state, row[0])
            out += shown
            state, shown = self.take(state, row)
            out.append(shown)
        state, shown = self.pass_time(state, passed)
        out += shown
        if state != before:
            self.state.update(state)
            call = self.next_call(state)
            if call is not None:
                self._call_at(call)
        if len(due) == len(rows):
            self.waiting.clear()
        elif due:
            self.waiting.put(rows[len(due):])
            self._call_at(rows[len(due)][0])
        for shown in out:
            yield self.shown_row(key, shown)


def _in_order(rows: DataFrame, key: str, ts: str, late: str, processor: InOrder, output: str, mode: str) -> DataFrame:
    # Such states are only kept in RocksDB; Spark notes the store of a stream in its checkpoint.
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    processor.shown = [key, *[part.split()[0] for part in output.split(",")]]
    rows = rows.where(F.col(ts).isNotNull()).withWatermark(ts, late).withColumn("at", F.unix_micros(F.col(ts)))
    return rows.groupBy(key).transformWithState(processor, f"{key} string, {output}", mode, "EventTime")


class Smoothing(InOrder):
    """The shown score moves at most ``max_delta`` from the last one."""

    waiting_type = "score double"
    state_type = "score double"

    def __init__(self, max_delta: float):
        self.max_delta = max_delta

    def take(self, state, row):
        score = min(max(row[1], 0.0), 1.0)
        if state is not None:
            score = min(max(state[0] + min(max(score - state[0], -self.max_delta), self.max_delta), 0.0), 1.0)
        return (score,), (row[0], score)


def smoothed_scores(scored: DataFrame, max_delta: float = 0.02, ts: str = "Last_Update", key: str = "Plate",
                    late: str = "10 minutes") -> DataFrame:
    """Per vehicle the score moves at most ``max_delta`` from its last shown score."""
    rows = scored.select(F.col(key).cast("string").alias(key), ts, F.col("Calculated_Risk_Score").cast("double").alias("score"))
    shown = _in_order(rows.where("score IS NOT NULL"), key, ts, late, Smoothing(max_delta), "at long, score double", "append")
    return shown.select(key, F.timestamp_micros("at").alias(ts), F.col("score").alias("Calculated_Risk_Score"))


class Counters(InOrder):
    """Growth of cumulative counters; a counter that falls back counts as no growth."""

    waiting_type = "harsh double, km double, night double"
    state_type = "last_harsh double, last_km double, harsh double, km double, night_km double, seen long"

    def take(self, state, row):
        _, harsh, km, night = row
        last_harsh, last_km, *totals = state or (None, None, 0.0, 0.0, 0.0, 0)
        grown = km if last_km is None else max(km - last_km, 0.0)
        more = harsh if last_harsh is None else max(harsh - last_harsh, 0.0)
        return (harsh, km, totals[0] + more, totals[1] + grown, totals[2] + grown * night, totals[3] + 1), ()

    def show(self, key):
        """Totals with the rows that still wait: later rows may come between them and correct the totals."""
        state = self._state()
        for row in self._rows():
            state, _ = self.take(state, row)
        yield self.shown_row(key, state[2:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for _ in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            pass  # the totals have been shown when the rows came
        return iter(())


def running_counters(events: DataFrame, ts: str = "Last_Update", key: str = "Plate", late: str = "10 minutes") -> DataFrame:
    """Running harsh events and distance per driver from cumulative counters (update mode).

    A counter that falls back counts as no growth; the first row counts in full.
    """
    harsh = (num(events, "Harsh_Brake_Count", 0.0) + num(events, "Harsh_Accel_Count", 0.0)
             + num(events, "Harsh_Corner_Count", 0.0))
    rows = events.select(
        F.col(key).cast("string").alias(key), ts, harsh.cast("double").alias("harsh"),
        num(events, "Trip_Distance_km", 0.0).cast("double").alias("km"),
        num(events, "Night_Driving_Flag", 0.0).cast("double").alias("night"))
    output = "harsh_event_total double, trip_distance_km double, night_distance_km double, observation_count long"
    return _in_order(rows, key, ts, late, Counters(), output, "update")


class Holding(InOrder):
    """T5: the stored level holds for its hours; the end of a hold is told by the clock, without a row."""

    waiting_type = "candidate string, score double, hold double"
    state_type = "level string, since long, score double, until long, told boolean"

    def __init__(self, hours: dict[str, float], otherwise: float = 24.0):
        self.hours, self.otherwise = hours, otherwise

    def _length(self, level: str | None, own: float | None) -> int:
        hours = own if own is not None and own > 0 else self.hours.get(level, self.otherwise)
        return round(hours * 3_600_000_000)

    def take(self, state, row):
        at, candidate, score, own = row
        if state is None or at - state[1] >= self._length(state[0] or candidate, own):
            state = (candidate, at, score, at + self._length(candidate, own), False)
        elif own is not None and own > 0:  # the vehicle's own hold counts from now on
            state = (*state[:3], state[1] + self._length(state[0], own), False)
        return state, (at, *state[:3], False)

    def pass_time(self, state, until):
        if state is None or state[4] or state[3] > until:
            return state, []
        return (*state[:4], True), [(state[3], *state[:3], True)]

    def next_call(self, state):
        return None if state[4] else state[3]


def sticky_severities(assessed: DataFrame, ts: str = "Last_Update", key: str = "Plate", late: str = "10 minutes") -> DataFrame:
    """T5: severity per vehicle, kept until the hold time of the stored level has passed in event time.

    Input columns: key, ``ts``, ``Candidate_Severity``, ``Composite_Score`` and optionally
    ``Severity_Hold_Hours`` or ``Severity_Hold_Days``. Besides a row for each input row, the end of
    each hold is a row of its own (``Hold_Over``), at the time it ends, without waiting for input.
    """
    own = num(assessed, "Severity_Hold_Hours")
    if "Severity_Hold_Hours" not in assessed.columns and "Severity_Hold_Days" in assessed.columns:
        own = num(assessed, "Severity_Hold_Days") * 24
    rows = assessed.select(F.col(key).cast("string").alias(key), ts, F.col("Candidate_Severity").cast("string").alias("candidate"),
                           F.col("Composite_Score").cast("double").alias("score"), own.cast("double").alias("hold"))
    output = "at long, Severity string, since long, composite_score double, Hold_Over boolean"
    shown = _in_order(rows, key, ts, late, Holding(dict(K.SEVERITY_HOLD_HOURS)), output, "append")
    return shown.select(key, F.timestamp_micros("at").alias(ts), "Severity", F.timestamp_micros("since").alias("last_updated"),
                        "composite_score", "Hold_Over")
