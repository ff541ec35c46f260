"""Registered streaming queries: run over the test files until nothing is left, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.cluster import ship
from tokenloom.plans.catalogue import query
from tokenloom.streaming import state, windows


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 373."""
    out = windows.drained(windows.tumbling(windows.events_stream(spark, sf_dir), "1 hour", "event_type"), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH s AS (SELECT ts, value, unnest([0, 1, 2]) AS k FROM events) SELECT CAST(date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS TIMESTAMP) AS start, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY 1""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 373: three hours, every hour."""
    out = windows.drained(windows.sliding(windows.events_stream(spark, sf_dir), "3 hours", "1 hour"), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 374."""
    out = windows.drained(windows.sessions(windows.events_stream(spark, sf_dir), "2 hours", "user_id"), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 379: one request a minute of each kind, by a clock a hundred times slower; tested against the same steps in plain Python."""
    ship(spark)
    e = windows.events_stream(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e8).alias("at"), F.lit(1.0).alias("need"))
    return windows.drained(state.rate_limited(e, 1.0), "append")


@query("""SELECT event_type AS kind, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 381: users of each kind of event, each once."""
    first = windows.distinct_within(windows.events_stream(spark, sf_dir).select("ts", "user_id", "event_type"), "user_id", "event_type", delay="3650 days")
    return windows.drained(first, "append").groupBy(F.col("event_type").alias("kind")).agg(F.countDistinct("user_id").alias("users"))
