"""Registered queries of the text rules, of arithmetic on scores, and of what is removed from or asked of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import numbers, text
from tokenloom.operators import agents, memory, metrics, ranking, sequences
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import EDGES, REQUESTS, edges, requests, table


@query("""SELECT event_id, event_type || ' ' || user_id AS line FROM events""")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 239: colours and cursor moves around every event's name."""
    line = F.format_string("\u001b[1;31m%s\u001b[0m\u001b[2K %d", "event_type", "user_id")
    return table(spark, sf_dir, "events").select("event_id", text.strip_ansi(line).alias("line"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'api_key=<redacted> ' WHEN 1 THEN 'Password : <redacted> ' WHEN 2 THEN 'use <redacted> ' ELSE 'tokens 12 ' END || event_type AS line FROM events""")
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 302: three forms of secret and one that is none."""
    secret, i = F.substring(F.md5(F.col("event_id").cast("string")), 1, 20), F.col("event_id") % 4
    line = F.when(i == 0, F.concat(F.lit("api_key="), secret)).when(i == 1, F.concat(F.lit("Password : "), secret)).when(i == 2, F.concat(F.lit("use sk-"), secret)).otherwise(F.lit("tokens 12"))
    return table(spark, sf_dir, "events").select("event_id", text.redact(F.concat(line, F.lit(" "), F.col("event_type"))).alias("line"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_found' WHEN 1 THEN 'timeout' WHEN 2 THEN 'permission' WHEN 3 THEN 'syntax' WHEN 4 THEN 'not_found' ELSE 'other' END AS kind FROM events""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 314: five failures around every event's name, one of them of two kinds, and a line without any."""
    forms = ["%s: No such file or directory", "%s timed out", "open %s: Permission denied", "SyntaxError in %s", "%s: file not found, timeout", "%s done"]
    line = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        line = F.when(F.col("event_id") % 6 == i, F.format_string(form, "event_type")).otherwise(line)
    return table(spark, sf_dir, "events").select("event_id", text.error_class(line).alias("kind"))


@query("""SELECT event_id, 'user:* about type:* ' || event_type AS pattern FROM events""")
def anonymised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 321."""
    asked = F.format_string("user:%d about type:%s %s", "user_id", "event_type", "event_type")
    return table(spark, sf_dir, "events").select("event_id", text.anonymise_query(asked).alias("pattern"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'messages' WHEN 1 THEN 'chat' WHEN 2 THEN 'responses' ELSE 'other' END AS endpoint FROM pages""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 74: a path at the end of every page's address."""
    tail = F.element_at(F.array(*map(F.lit, ["/v1/messages", "/v1/chat/completions", "/v1/responses", "/v1/messages/count"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", agents.endpoint(F.concat("url", tail)).alias("endpoint"))


@query("""SELECT p_partkey, CAST(ceil((p_partkey % 2000 + 1) * (p_size * 20) / 750.0) AS BIGINT) AS tokens FROM part""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 294: keys and sizes of parts taken for widths and heights."""
    return table(spark, sf_dir, "part").select("p_partkey", numbers.image_tokens(F.col("p_partkey") % 2000 + 1, F.col("p_size") * 20).alias("tokens"))


@query("""SELECT o_orderkey, CAST(bit_count(xor(CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT))) AS INTEGER) AS distance FROM orders""")
def key_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 287."""
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.hamming(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")).alias("distance"))


@query("""SELECT k, CAST(greatest(1, round_even(k * 0.3, 0)) AS INTEGER) AS front, CAST(greatest(1, round_even(k * 0.15, 0)) AS INTEGER) AS back,
CAST(greatest(0, k - greatest(1, round_even(k * 0.3, 0)) - greatest(1, round_even(k * 0.15, 0))) AS INTEGER) AS rest FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS k FROM lineitem)""")
def k_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 180: every quantity taken for a number of items to keep."""
    k = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("k")).distinct()
    front, back, rest = numbers.k_split(F.col("k").cast("double"))
    return k.select("k", front.cast("int").alias("front"), back.cast("int").alias("back"), rest.cast("int").alias("rest"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS p, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') END AS age FROM orders)
SELECT id, round(p * CASE WHEN age IS NULL OR age < 0 THEN 1.0 ELSE exp(-age / 30.0) END, 4) AS weight, round(p / 1000000 * exp(-0.01 * coalesce(age, 0)) + least(0.3, 0.05 * (id % 9)), 9) AS strength FROM o""")
def memory_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 165, 166: orders taken for memories; every tenth has no time, late ones have a future one."""
    age = F.when(F.col("o_orderkey") % 10 != 0, F.datediff(F.lit("1998-06-01").cast("date"), F.col("o_orderdate").cast("date")))
    price = F.col("o_totalprice").cast("double")
    weight, strength = numbers.recency(price, age), numbers.decayed(price / 1000000, F.coalesce(age, F.lit(0)), F.col("o_orderkey") % 9)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(weight, 4).alias("weight"), F.round(strength, 9).alias("strength"))


@query("""WITH s AS (SELECT lang, avg(length(text)) AS m, stddev_samp(length(text)) AS sd FROM documents GROUP BY 1)
SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS size FROM documents JOIN s USING (lang) WHERE sd > 0 AND abs(length(text) - m) > 2 * sd""")
def length_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 147: texts of unusual length in their language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("size"))
    return sequences.anomalies(d, "lang", "size").select("doc_id", "lang", "size")


@query("""SELECT l_returnflag AS kind, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance, round(stddev_samp(v), 6) AS deviation, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75
FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY 1""")
def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 148, 149."""
    found = sequences.statistics(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("double").alias("v")), "kind", "v")
    return found.select("kind", *(F.round(c, 6).alias(c) for c in found.columns if c != "kind"))


@query(f"""WITH {REQUESTS}, s AS (SELECT instance, CAST(sum(before - after) AS BIGINT) AS saved, CAST(sum(after) AS BIGINT) AS input FROM requests GROUP BY 1)
SELECT instance, saved, input, CASE WHEN saved + input = 0 THEN 0.0 ELSE round(100.0 * saved / (saved + input), 2) END AS percent FROM s""")
def instance_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 109."""
    return metrics.savings_snapshot(requests(spark, sf_dir), "instance")


@query(f"""WITH {EDGES}, gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) SELECT a, b FROM edges WHERE a NOT IN (SELECT id FROM gone) AND b NOT IN (SELECT id FROM gone)""")
def remaining_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 336: customers and suppliers in debt are removed."""
    of = lambda name, kind: table(spark, sf_dir, name).where(f"{kind}_acctbal < 0").select(F.concat(F.lit(kind), F.col(f"{kind}_{'cust' if kind == 'c' else 'supp'}key").cast("string")).alias("id"))
    return memory.without_nodes(edges(spark, sf_dir), of("customer", "c").union(of("supplier", "s")))


@query(f"""WITH {EDGES}, asked AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'r' || r_regionkey FROM region) SELECT DISTINCT a, b FROM edges WHERE a IN (SELECT id FROM asked) OR b IN (SELECT id FROM asked)""")
def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 333: the relations of customers in debt and of all regions, in either direction."""
    asked = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return memory.incident(edges(spark, sf_dir), asked.union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")))))


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM conversations), g AS (SELECT conv_id, turn, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.g) = 0 THEN 0.0 ELSE len(list_filter(a.g, lambda x: list_contains(b.g, x))) / CAST(len(a.g) AS DOUBLE) END, 6) AS echo FROM g a JOIN g b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def turn_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 308: word pairs of a turn that the turn before has."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ranking.echo_ratio(F.col("text"), F.col("context"), 2), 6).alias("echo"))
