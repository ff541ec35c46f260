"""Queries of reads and writes of files, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.cluster import ship
from tokenloom.operators import reads
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import requests
from tokenloom.streaming import reads as stream_reads
from tokenloom.streaming import windows

_HOUR = 3_600_000
_EVENTS = """e AS (
  SELECT user_id AS session, epoch_us(ts) // 1000 AS at_, 'f' || (event_id % 7) AS path, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS low, CAST(json_extract_string(props, '$.k') AS INTEGER) + 20 + CAST(event_id % 13 AS INTEGER) AS high, CAST(floor(value) AS BIGINT) * 10 + 1 AS bytes FROM events
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads and writes of seven files, a user a session, times in milliseconds."""
    r = requests(spark, sf_dir)
    kind = F.when(F.col("model").isin("view", "click"), "read").otherwise("write")
    low = F.col("k").cast("int")
    return r.select(F.col("instance").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("path"), kind.alias("kind"), low.alias("low"), (low + 20 + (F.col("id") % 13).cast("int")).alias("high"), (F.floor("value") * 10 + 1).cast("long").alias("bytes"))


@query(f"""WITH {_EVENTS}, l AS (SELECT *, unnest(range(low, high)) AS line FROM e),
w AS (SELECT *, lag(kind) OVER o AS before, coalesce(max(CASE WHEN kind = 'write' THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM l WINDOW o AS (PARTITION BY session, path, line ORDER BY at_, kind, low, high)),
r AS (SELECT session, path, at_, low, high, bytes, count(*) AS n, count(*) FILTER (before IS NULL) AS fresh, count(*) FILTER (before = 'read') AS repeated, count(*) FILTER (before = 'write') AS written_back, CAST(sum(later) AS BIGINT) AS stale FROM w WHERE kind = 'read' GROUP BY ALL)
SELECT session, path, at_ AS at, low, high, fresh, repeated, written_back, stale, bytes * repeated // n AS repeated_bytes, bytes * written_back // n AS written_back_bytes, bytes * stale // n AS stale_bytes,
CASE n WHEN repeated THEN 'repeated' WHEN written_back THEN 'written_back' WHEN fresh THEN 'fresh' ELSE 'mixed' END AS verdict FROM r""")
def audited_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 132."""
    return reads.audited_reads(_events(spark, sf_dir))


_MATURE = _EVENTS + f""", t AS (SELECT DISTINCT session, path, at_ FROM e), n AS (SELECT *, lead(at_) OVER (PARTITION BY session, path ORDER BY at_) AS next_ FROM t),
q AS (SELECT *, min(CASE WHEN next_ IS NULL OR next_ - at_ >= {48 * _HOUR} THEN at_ + {48 * _HOUR} END) OVER (PARTITION BY session, path ORDER BY at_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS quiet FROM n),
m AS (SELECT e.session, e.path, e.at_, least(quiet, e.at_ + {240 * _HOUR}) AS matures FROM e JOIN q ON q.session = e.session AND q.path = e.path AND q.at_ = e.at_ WHERE kind = 'read')"""


@query(f"""WITH {_MATURE}, s AS (SELECT session, max(at_) AS end_ FROM e GROUP BY 1) SELECT m.session, path, at_ AS at, CASE WHEN matures <= end_ THEN matures END AS matures FROM m JOIN s ON s.session = m.session""")
def matured_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 346, 347: quiet for two days or held for ten."""
    e = _events(spark, sf_dir)
    return reads.matured_reads(e, 48 * _HOUR, 240 * _HOUR, e.groupBy("session").agg(F.max("at").alias("end")))


@query(f"""WITH {_MATURE} SELECT DISTINCT CAST(session AS VARCHAR) AS session, path, at_ AS at, matures FROM m WHERE matures <= (SELECT max(at_) - {_HOUR} FROM e)""")
def stream_matured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 347: the same by a stream's state and timers, as far as its watermark has come."""
    ship(spark)
    s = windows.events_stream(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write")
    events = s.select(F.col("user_id").cast("string").alias("session"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("path"), "ts", kind.alias("kind"))
    before = spark.conf.get(stream_reads.STORE[0])
    try:
        out = windows.drained(stream_reads.maturing(events, "48 hours", "240 hours", "1 hour"), "append")
    finally:
        spark.conf.set(stream_reads.STORE[0], before)
    return out.select("session", "path", *(F.unix_millis(c).alias(c) for c in ("at", "matures"))).distinct()
