"""Registered queries of the parsers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import LOG_LINES, REQUESTS, log_lines, requests, table
from tokenloom.sources import readers


@query("""SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders""")
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 9, 12: a CSV text of each customer's orders, parsed again."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat_ws(",", r["o_orderkey"].cast("string"), r["o_orderstatus"])), "\n")
    parsed = readers.parse_table(o.select("o_custkey", F.concat(F.lit("id,status\n"), body).alias("t")), "o_custkey", "t", "csv")
    return parsed.select("o_custkey", "row", F.col("cells")["id"].alias("id"), F.col("cells")["status"].alias("status"))


@query("""SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row, n_name AS name FROM nation""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 10."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), r["n_nationkey"].cast("string"), F.lit(" | "), r["n_name"], F.lit(" |"))), "\n")
    parsed = readers.parse_table(n.select("n_regionkey", F.concat(F.lit("| key | name |\n|---|---|\n"), body).alias("t")), "n_regionkey", "t", "markdown")
    return parsed.select("n_regionkey", "row", F.col("cells")["name"].alias("name"))


@query(f"""WITH {LOG_LINES} SELECT n, CAST(regexp_extract(line, 'value=([0-9]+)', 1) AS BIGINT) AS value FROM log_lines""")
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 24."""
    return log_lines(spark, sf_dir).select("n", readers.key_values(F.col("line"))["value"].cast("long").alias("value"))


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1""")
def concatenated_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 15: the properties of each user's events one after another, read as an array."""
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list("props"), "\n").alias("t"))
    return each.select("user_id", F.size(F.from_json(readers.joined_json(F.col("t")), "array<map<string,int>>")).cast("long").alias("n"))


@query(f"""WITH {REQUESTS} SELECT 'requests{{model="' || model || '",mode="' || mode || '"}} ' || count(*) AS line FROM requests GROUP BY model, mode""")
def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 32."""
    return readers.prometheus(requests(spark, sf_dir).groupBy("model", "mode").agg(F.count("*").alias("n")), "requests", "n", ["model", "mode"])
