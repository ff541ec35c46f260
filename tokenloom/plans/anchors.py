"""Queries of anchors and of reads, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import anchors
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import LOG_LINES, log_lines, table


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.floor("value") / 100).alias("score"))
    return log_lines(spark, sf_dir).select(F.col("log_id").alias("key"), F.col("n").alias("i"), F.col("line").alias("value")).join(score, "i")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each log is taken for, and what is asked of it."""
    key = F.col("key")
    pattern = F.element_at(F.array(*map(F.lit, ("search_results", "logs", "time_series", "generic"))), (key % 4 + 1).cast("int"))
    said = F.when(key % 3 == 0, F.concat(F.lit("the latest of 'User-"), (key % 50).cast("string"), F.lit("'"))).when(key % 3 == 1, "the first entry").otherwise("")
    return log_lines(spark, sf_dir).select(F.col("log_id").alias("key")).distinct().select("key", pattern.alias("pattern"), said.alias("query"))


_ANCHORS = LOG_LINES + """, it AS (SELECT log_id AS key, l.n AS i, line, floor(value) / 100 AS score, row_number() OVER (PARTITION BY log_id ORDER BY l.n) - 1 AS p, count(*) OVER (PARTITION BY log_id) AS n FROM log_lines l JOIN events e ON e.event_id = l.n),
b AS (SELECT DISTINCT key, n, CASE key % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.15 WHEN 2 THEN 0.45 ELSE 0.5 END AS f, CASE key % 4 WHEN 0 THEN 0.15 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 ELSE 0.4 END AS k FROM it),
m AS (SELECT key, n, CASE key % 3 WHEN 0 THEN greatest(0.1, f - 0.15) WHEN 1 THEN least(0.8, f + 0.15) ELSE f END AS f, CASE key % 3 WHEN 0 THEN least(0.8, k + 0.15) WHEN 1 THEN greatest(0.1, k - 0.15) ELSE k END AS k FROM b),
w AS (SELECT key, n, 10 AS budget, f / (f + k + 0.1) AS f, k / (f + k + 0.1) AS k FROM m),
s AS (SELECT key, n, budget, greatest(1, CAST(floor(round(budget * f, 9)) AS INT)) AS fs, greatest(1, CAST(floor(round(budget * k, 9)) AS INT)) AS bs FROM w),
t AS (SELECT *, greatest(0, budget - fs - bs) AS ms FROM s),
r AS (SELECT key, 0 AS low, least(2 * fs, n // 3) AS high, fs AS c FROM t UNION ALL SELECT key, greatest(n - 2 * bs, 2 * n // 3), n, bs FROM t),
ends AS (SELECT key, least(high - 1, low + CAST(floor(round((j + 1) * (high - low) / (c + 1), 9)) AS INT)) AS p FROM (SELECT *, unnest(range(c)) AS j FROM r)),
mid AS (SELECT key, ms, least(high - 1, low + CAST(floor(round((j + 1) * (high - low) / (c + 1), 9)) AS INT)) AS p FROM (SELECT *, unnest(range(c)) AS j FROM (SELECT key, ms, fs AS low, n - bs AS high, least(3 * ms, n - bs - fs) AS c FROM t))),
best AS (SELECT key, p FROM (SELECT mid.*, row_number() OVER (PARTITION BY mid.key ORDER BY score DESC, mid.p) AS z FROM mid JOIN it ON it.key = mid.key AND it.p = mid.p WHERE NOT EXISTS (FROM ends WHERE ends.key = mid.key AND ends.p = mid.p)) WHERE z <= ms),
kept AS (SELECT it.key, it.i FROM it JOIN (SELECT * FROM ends UNION SELECT * FROM best) a ON a.key = it.key AND a.p = it.p WHERE it.n > 40 UNION SELECT key, i FROM it WHERE n <= 40)"""


@query(f"WITH {_ANCHORS} SELECT key, i FROM kept")
def log_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 181: ten places of each log, by what it is taken for and what is asked."""
    return anchors.anchors(_logs(spark, sf_dir), _told(spark, sf_dir), 40)


@query(f"""WITH {_ANCHORS}, forced AS (SELECT key, i FROM it WHERE key % 3 = 0 AND contains(lower(line), 'user-' || (key % 50)))
SELECT coalesce(k.key, f.key) AS key, coalesce(k.i, f.i) AS i, f.i IS NOT NULL AS forced FROM kept k FULL JOIN forced f ON f.key = k.key AND f.i = k.i""")
def forced_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 222: the same, and every line that names what is asked for."""
    items, told = _logs(spark, sf_dir), _told(spark, sf_dir)
    names = told.select("key", anchors.query_anchors(F.col("query")).alias("names"))
    return anchors.with_forced(anchors.anchors(items, told, 40), items, names)


@query("""SELECT o_custkey AS key, o_orderkey AS i FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'""")
def preserved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 223: orders of whose two hashed fields one has a value that the question holds."""
    o = table(spark, sf_dir, "orders")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("o_orderstatus", "o_orderpriority", "o_totalprice")])).alias("f")
    fields = o.withColumn("o_totalprice", F.lit("urgent")).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("i"), each).select("key", "i", "f.*")
    # the hashes of o_orderstatus and o_orderpriority; the question holds the letter of status P and no other
    hashes = [hashlib.sha256(c.encode()).hexdigest()[:8] for c in ("o_orderstatus", "o_orderpriority")]
    return anchors.preserved(fields, hashes, F.lit("1-URGENT pack"))
