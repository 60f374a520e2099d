"""Streaming queries, driven to completion over a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.plans.registry import query
from tallymill.session import read_table, shared_dir
from tallymill.streaming import jobs, replays


def _events(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    return jobs.read_files(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windowed_totals", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def stream_windowed_totals(spark, sf_dir):
    out = jobs.run_once(jobs.windowed_totals(_events(spark, sf_dir), "ts", "event_type", "value", "1 day", "2 days"), "complete", "windows")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("stream_first_seen", "SELECT DISTINCT event_id FROM events")
def stream_first_seen(spark, sf_dir):
    return jobs.run_once(jobs.first_seen(_events(spark, sf_dir), "ts", ["event_id"], "40 days").select("event_id"), "append", "seen")


@query(
    "stream_sliding_totals",
    """SELECT day - to_hours(8 * k::INTEGER) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
    FROM (SELECT *, time_bucket(INTERVAL 8 HOUR, ts)::TIMESTAMP AS day FROM events), range(3) AS r(k) GROUP BY 1, 2""",
)
def stream_sliding_totals(spark, sf_dir):
    """Days that begin every eight hours."""
    out = jobs.run_once(jobs.windowed_totals(_events(spark, sf_dir), "ts", "event_type", "value", "24 hours", "2 days", "8 hours"), "complete", "sliding")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    out = jobs.run_once(jobs.sessions(_events(spark, sf_dir), "ts", "user_id", "6 hours", "2 days"), "complete", "sessions")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_replays",
    """WITH t AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events), x AS (SELECT a.user_id::VARCHAR AS receipt, a.event_type AS request, b.event_type AS earlier_request, row_number() OVER (PARTITION BY a.event_id ORDER BY b.sec DESC, b.event_type DESC) AS n
    FROM t a JOIN t b ON b.user_id = a.user_id AND b.event_type <> a.event_type AND a.sec - b.sec <= 7200 AND (b.sec < a.sec OR b.sec = a.sec AND b.event_type < a.event_type)) SELECT receipt, request, earlier_request FROM x WHERE n = 1""",
)
def stream_replays(spark, sf_dir):
    """Users as receipts and kinds of event as requests, two hours long."""
    with replays.rocksdb_state(spark):
        return jobs.run_once(replays.replays(_events(spark, sf_dir), "ts", "user_id", "event_type", 7200), "append", "replays")


@query("stream_silver_batches", "SELECT user_id, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE value >= 10 GROUP BY 1")
def stream_silver_batches(spark, sf_dir):
    """Good rows kept by micro-batch, each under its number, and read back over all of them."""
    root = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    q = jobs.silver_micro_batches(_events(spark, sf_dir), lambda batch: {"facts": batch.filter("value >= 10")}, f"{root}/out", f"{root}/state")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out/facts").groupBy("user_id")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
