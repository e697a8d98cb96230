"""Streaming queries run over the tables to their end, and the SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import micros
from lodestone.streaming import jobs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.source(spark, d, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def stream_dedup_append(spark: SparkSession, d: str) -> DataFrame:
    """An append-only stream with its identities once, then counted."""
    s = jobs.source(spark, d, "movement.parquet").withColumn("at", F.col("started_at").cast("timestamp")).where("at IS NOT NULL").select("call_id", "direction", "at")
    return jobs.run(jobs.deduplicated(s, ["call_id"], "at", "1000 days")).groupBy("direction").agg(F.count(F.lit(1)).alias("calls"))


def stream_dedup_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, where an identity is forgotten 120 seconds behind the latest event, counted by kind."""
    e = _events(spark, d).select("event_id", "event_type", "at")
    return jobs.run(jobs.deduplicated(e, ["event_id"], "at", "120 seconds")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind of the windows closed at the end of the stream (two hours behind the last event)."""
    return jobs.run(jobs.windowed(_events(spark, d), ["event_type"], "at", "1 hour", "2 hours"))


def stream_lag(spark: SparkSession, d: str) -> DataFrame:
    """Samples with the time from observation to receipt, added up per metric."""
    s = jobs.source(spark, d, "samples.parquet").select("sample_id", "metric", (micros(F.col("received_at")) - micros(F.col("observed_at"))).alias("lag_us"))
    out = jobs.run(s.where("lag_us IS NOT NULL")).distinct()
    return out.groupBy("metric").agg(F.count(F.lit(1)).alias("samples"), F.max("lag_us").alias("most_us"))


QUERIES = {f.__name__: f for f in (stream_dedup_append, stream_dedup_horizon, stream_hourly_counts, stream_lag)}

SQL = {
    "stream_dedup_append": "SELECT direction, count(DISTINCT call_id) AS calls FROM movement WHERE started_at IS NOT NULL GROUP BY 1",
    "stream_dedup_horizon": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "stream_hourly_counts": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2",
    "stream_lag": "SELECT metric, count(*) AS samples, max(g) AS most_us FROM (SELECT DISTINCT sample_id, metric, epoch_us(received_at) - epoch_us(observed_at) AS g FROM samples) WHERE g IS NOT NULL GROUP BY 1",
}
