"""Queries of crushed JSON, those that SQL can express beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import nested
from tokenloom.operators.lines import joined
from tokenloom.operators.tables import json_string
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import LOG_LINES, log_lines, table

_RULE = """, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY key) AS n, avg(length(value)) OVER (PARTITION BY key) AS mean, stddev_samp(length(value)) OVER (PARTITION BY key) AS sd FROM items),
f AS (SELECT *, value LIKE '%ERROR%' AS failing, coalesce(sd > 0 AND abs(length(value) - mean) > 2 * sd, false) AS odd FROM p),
e AS (SELECT *, failing OR odd OR p < 4 OR p >= n - 2 AS keep FROM f),
t AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY key) AS kept, sum(CAST(failing AS INT) + CAST(odd AS INT)) OVER (PARTITION BY key) AS extra, max(CAST(keep AS INT)) OVER (PARTITION BY key, value) AS seen FROM e),
a AS (SELECT *, 12 - kept > 0 AND NOT keep AND seen = 0 AND p % greatest(1, (n - 1) // (greatest(0, 12 - kept) + 1)) = 0 AS asked FROM t),
w AS (SELECT *, asked AND row_number() OVER (PARTITION BY key, value, asked ORDER BY p) = 1 AS fresh FROM a),
z AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY key ORDER BY p) AS turn FROM w)
SELECT key, i, value FROM z WHERE n <= 8 OR keep OR (fresh AND turn <= 12 + extra - kept)"""


@query(f"""WITH {LOG_LINES}, items AS (SELECT log_id AS key, n AS i, line AS value FROM log_lines){_RULE}""")
def crushed_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 204: a hundred log lines to an array."""
    items = log_lines(spark, sf_dir).select(F.col("log_id").alias("key"), F.col("n").alias("i"), F.col("line").alias("value"))
    return nested.kept_strings(items, 12)


@query("""WITH e AS (SELECT o_custkey AS key, o_orderkey AS i, 'order' || o_orderkey AS name, '"' || repeat(o_orderpriority, CAST(1 + o_orderkey % 5 AS INT)) || '"' AS json FROM orders),
p AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY key) AS n, strlen(json) // 4 + strlen(name) // 4 + 2 AS tokens FROM e WINDOW w AS (PARTITION BY key ORDER BY i)),
k AS (SELECT *, tokens <= 12 OR p < 2 OR p >= n - 1 AS keep, sum(tokens) OVER (PARTITION BY key) AS all_ FROM p),
t AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY key) AS kept FROM k),
a AS (SELECT *, kept < 6 AND NOT keep AND p % greatest(1, (n - 1) // (greatest(0, 6 - kept) + 1)) = 0 AS asked FROM t),
z AS (SELECT *, sum(CAST(asked AS INT)) OVER (PARTITION BY key ORDER BY p) AS turn FROM a)
SELECT key, i, name FROM z WHERE n <= 8 OR all_ < 100 OR n <= 6 OR keep OR (asked AND turn <= 6 - kept)""")
def crushed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 206: a customer's orders as an object's entries."""
    o = table(spark, sf_dir, "orders")
    value = F.concat(F.lit('"'), F.expr("repeat(o_orderpriority, CAST(1 + o_orderkey % 5 AS INT))"), F.lit('"'))
    entries = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("i"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"), value.alias("json"))
    return nested.kept_keys(entries, 6, 100).select("key", "i", "name")


@query("""WITH items AS (SELECT user_id AS key, event_id AS i, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(floor(value) AS VARCHAR) WHEN 2 THEN 'true' ELSE '[' || user_id || ']' END AS value FROM events),
g AS (SELECT *, count(*) OVER (PARTITION BY key) AS all_, count(*) OVER (PARTITION BY key, k) AS n, row_number() OVER (PARTITION BY key, k ORDER BY i) - 1 AS p FROM items),
x AS (SELECT *, CASE WHEN k = 1 THEN CAST(value AS DOUBLE) WHEN k = 0 THEN length(value) END AS x FROM g),
s AS (SELECT *, coalesce(stddev_samp(x) OVER w > 0 AND abs(x - avg(x) OVER w) > 2 * stddev_samp(x) OVER w, false) AS far FROM x WINDOW w AS (PARTITION BY key, k)),
e AS (SELECT *, far OR (k = 0 AND value = 'error') OR p < 2 OR p >= n - 1 AS keep FROM s),
t AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY key, k) AS kept, sum(CAST(far AS INT) + CAST(k = 0 AND value = 'error' AS INT)) OVER (PARTITION BY key, k) AS extra, max(CAST(keep AS INT)) OVER (PARTITION BY key, k, value) AS seen FROM e),
a AS (SELECT *, 5 - kept > 0 AND NOT keep AND seen = 0 AND p % greatest(1, (n - 1) // (greatest(0, 5 - kept) + 1)) = 0 AS asked FROM t),
w AS (SELECT *, asked AND row_number() OVER (PARTITION BY key, k, value, asked ORDER BY p) = 1 AS fresh FROM a),
z AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY key, k ORDER BY p) AS turn FROM w),
y AS (SELECT *, n <= 8 OR keep OR (fresh AND turn <= 5 + extra - kept) AS own FROM z),
same AS (SELECT DISTINCT key, value FROM y WHERE k = 0 AND own)
SELECT y.key, i FROM y LEFT JOIN same ON same.key = y.key AND same.value = y.value AND y.k = 0 WHERE all_ <= 8 OR n < 5 OR k IN (2, 3) OR (k = 1 AND keep) OR (k = 0 AND same.key IS NOT NULL)""")
def crushed_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 200: a user's events as strings, numbers, booleans and arrays."""
    kind = F.col("event_id") % 4
    json = F.when(kind == 0, json_string(F.col("event_type"))).when(kind == 1, F.floor("value").cast("string")).when(kind == 2, "true").otherwise(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), F.parse_json(json).alias("item"))
    return nested.kept_items(items, 5).select("key", "i")


@query()
def crushed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 202: logs as documents of an array of lines, an inner object and an array of numbers."""
    one = F.concat(F.lit('{"line":'), json_string(F.col("line")), F.lit(',"n":'), F.col("n").cast("string"), F.lit("}"))
    rows = joined(log_lines(spark, sf_dir), "log_id", "n", one, "rows").select("log_id", F.replace("rows", F.lit("\n"), F.lit(",")).alias("rows"))
    json = F.concat(F.lit('{"log": {"rows": ['), "rows", F.lit(']}, "id": '), F.col("log_id").cast("string"), F.lit(', "sizes": ['), F.array_join(F.sequence(F.lit(1), F.lit(30)).cast("array<string>"), ","), F.lit("]}"))
    docs = rows.select(F.col("log_id").alias("id"), F.parse_json(json).alias("value"))
    return nested.crushed(docs, 12)[0]
