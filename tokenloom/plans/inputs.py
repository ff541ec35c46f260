"""Views of the test tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: a model a kind of event, tokens from the properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("instance"), F.col("event_type").alias("model"), "value", k.alias("k"))
    mode = F.when(F.col("id") % 3 == 0, "audit").when(F.col("id") % 3 == 1, "optimize").otherwise("simulate")
    before = F.col("k") * 100
    return events.withColumns({"mode": mode, "before": before, "after": F.greatest(F.lit(0).cast("long"), before - F.floor("value").cast("long"))})


REQUESTS = """requests AS (
  SELECT event_id AS id, ts, user_id AS instance, event_type AS model, value, k, CASE event_id % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'optimize' ELSE 'simulate' END AS mode,
         k * 100 AS before, greatest(0, k * 100 - CAST(floor(value) AS BIGINT)) AS after
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def beacon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of each instance that only grows."""
    from pyspark.sql import Window

    w = Window.partitionBy("instance").orderBy("ts", "id")
    return requests(spark, sf_dir).select("id", "ts", "instance", F.sum("k").over(w).alias("total"))


BEACON = REQUESTS + """, beacon AS (
  SELECT id, ts, instance, CAST(sum(k) OVER (PARTITION BY instance ORDER BY ts, id) AS BIGINT) AS total FROM requests
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.functions.text import token_estimate

    return table(spark, sf_dir, "conversations").withColumn("tokens", token_estimate(F.col("text")))


MESSAGES = """messages AS (
  SELECT *, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT)) END AS tokens FROM conversations
)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.operators.lines import exploded

    return exploded(table(spark, sf_dir, "documents"), "doc_id", "text")


DOC_LINES = """doc_lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines, a hundred to a log."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user-"), F.col("user_id").cast("string"), F.lit(" value="), F.floor("value").cast("string"))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("log_id"), F.col("event_id").alias("n"), line.alias("line"))


LOG_LINES = """log_lines AS (
  SELECT event_id // 100 AS log_id, event_id AS n,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ' user-' || user_id || ' value=' || CAST(floor(value) AS BIGINT) AS line
  FROM events
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as a graph."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    return (
        t("nation").select(node("r", "n_regionkey").alias("a"), node("n", "n_nationkey").alias("b"))
        .union(t("customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
        .union(t("supplier").select(node("n", "s_nationkey"), node("s", "s_suppkey")))
    )


EDGES = """edges AS (
  SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
)"""
