"""Incremental windows and streamed ingest over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.session import checkpoint_dir
from clipworks.sources import schemas
from clipworks.sources.tables import load_table
from clipworks.streaming import ingest


@query("st1_next_window", f"""WITH l AS (SELECT max(ts) AS e FROM events WHERE event_type IN ('view', 'click'))
SELECT {k.stamp("e - INTERVAL 10 MINUTE")} AS start_at, '2024-02-15 12:00:00' AS end_at, FALSE AS first_run FROM l""")
def next_window(spark, d):
    runs = load_table(spark, d, "events").select(F.col("ts").alias("window_end_at"), F.when(F.col("event_type").isin("view", "click"), "succeeded").otherwise("failed").alias("status"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return ingest.next_window(runs, "2024-02-15 12:00:00", "2024-01-01", 10).withColumns({"start_at": fmt("start_at"), "end_at": fmt("end_at")})


@query("st2_in_window", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 00:01:00'")
def in_window(spark, d):
    return ingest.in_window(load_table(spark, d, "events"), "ts", "2024-01-05", "2024-01-20").select("event_id")


@query("st3_ingest_stream", "SELECT event_id, event_type, user_id FROM events")
def ingest_stream(spark, d):
    """Every event arrives twice, as in overlapping windows; the store holds each once."""
    base = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING"
    stream = spark.readStream.schema(schemas.DRIVER["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).select("event_id", "ts", "user_id", "event_type")
    ingest.ingest_stream(twice, f"{base}/store", f"{base}/state", "event_id", "ts").awaitTermination()
    return ingest.read_store(spark, f"{base}/store", schema).select("event_id", "event_type", "user_id")


@query("st4_late_report", """SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'late' WHEN ts > TIMESTAMP '2024-01-20 00:01:00' THEN 'early' ELSE 'in_window' END AS arrival, count(*) AS n FROM events GROUP BY 1, 2""")
def late_report(spark, d):
    return ingest.late_report(load_table(spark, d, "events"), "ts", "2024-01-05", "2024-01-20", ["event_type"])
