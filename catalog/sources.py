"""Readers, writers and the state table, over tables that Spark derives from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import AS_OF, query, r
from catalog.scalars import QUOTE_SQL
from fleetrisk.functions.runtime import shared_folder
from fleetrisk.operators import pricing, rollups
from fleetrisk.sources import io


def _path(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/{uuid.uuid4().hex}-{name}"


_TYPED = "event_id bigint, Plate string, Last_Update timestamp_ntz, Speed_kmh double, City string"


@query("I1_csv_read", f"SELECT event_id, Plate, Last_Update, {r('Speed_kmh')}, City FROM history")
def _(v):
    path = _path(v, "history.csv")
    stamp = F.date_format(F.col("Last_Update").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    io.write_csv(v.history.select("event_id", "Plate", stamp.alias("Last_Update"), "Speed_kmh", "City"), path)
    return io.read_csv(v.spark, path, _TYPED)


@query("I1_rejected_rows", """SELECT CASE WHEN event_id % 10 < 3 THEN 'rejected' ELSE 'read' END AS part, count(*) AS observations, CAST(sum(event_id) AS BIGINT) AS ids FROM history GROUP BY 1""")
def _(v):
    """Of ten lines one is short, one long and one mistyped."""
    kind = F.col("event_id") % 10
    line = F.when(kind == 0, F.concat_ws(",", "event_id", "Plate")).when(kind == 1, F.concat_ws(",", "event_id", "Plate", F.lit("1.5"), "City", F.lit("more"))).when(
        kind == 2, F.concat_ws(",", "event_id", "Plate", F.lit("fast"), "City")).otherwise(F.concat_ws(",", "event_id", "Plate", "Speed_kmh", "City"))
    path = _path(v, "lines")
    v.history.select(line.alias("value")).write.text(path)
    good, rejected = io.read_csv_checked(v.spark, path, "event_id bigint, Plate string, Speed_kmh double, City string", header=False)
    ids = rejected.select(F.lit("rejected").alias("part"), F.split("line", ",")[0].cast("bigint").alias("id"))
    both = good.select(F.lit("read").alias("part"), F.col("event_id").alias("id")).union(ids)
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("observations"), F.sum("id").alias("ids"))


@query("I3_reader_by_suffix", "SELECT Plate, City, 'csv' AS suffix FROM portfolio UNION ALL SELECT Plate, City, 'parquet' FROM portfolio")
def _(v):
    rows, csv, parquet = v.portfolio.select("Plate", "City"), _path(v, "book.csv"), _path(v, "book.parquet")
    io.write_csv(rows, csv)
    rows.write.parquet(parquet)
    read = [io.load_portfolio(v.spark, path).withColumn("suffix", F.lit(name)) for path, name in ((csv, "csv"), (parquet, "parquet"))]
    return read[0].unionByName(read[1])


@query("I7_json_summary", f"SELECT count(*) AS total_vehicles, {r('avg(Calculated_Risk_Score)', 'avg_risk_score')}, {r('median(Calculated_Risk_Score)', 'median_risk_score')} FROM priced")
def _(v):
    path = _path(v, "summary.json")
    io.write_json_row(rollups.risk_kpis(v.priced), path)
    row = io.read_json_row(v.spark, path)
    names = ("total_vehicles", "avg_risk_score", "median_risk_score")
    return v.spark.createDataFrame([tuple(row[n] for n in names)], "total_vehicles long, avg_risk_score double, median_risk_score double")


@query("I8_state_table", "SELECT Plate, count(*) + 1 AS changes, 2 AS version FROM portfolio GROUP BY Plate")
def _(v):
    table = io.StateTable(v.spark, _path(v, "state"))
    table.replace(v.portfolio.groupBy("Plate").agg(F.count(F.lit(1)).alias("changes")))
    number = table.replace(table.read().withColumn("changes", F.col("changes") + 1))
    return table.read().withColumn("version", F.lit(number))


@query("U2_records_to_quotes", QUOTE_SQL)
def _(v):
    path = _path(v, "records")
    v.prepared.write.json(path)
    records = io.read_records(v.spark, path, v.prepared.schema)
    return pricing.quote(records, AS_OF).select(
        "Plate", "Risk_Band", "PPO_Action", "Risk_Based_Monthly_Premium_USD", "Risk_Based_Daily_Premium_USD",
        "Policy_Adjusted_Monthly_Premium_USD", "Policy_Adjusted_Daily_Premium_USD", "Expected_Claim_USD",
        "Decision_Status", "Decision_Timestamp")
