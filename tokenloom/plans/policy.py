"""Registered queries of the rules on requests, commands and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import policy
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import MESSAGES, REQUESTS, messages, requests, table


@query("""SELECT o_orderkey AS id, o_totalprice AS importance FROM orders ORDER BY importance DESC, id LIMIT 40 OFFSET 20""")
def memory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 36."""
    return policy.page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("importance")), "importance", "id", 40, 20)


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, event_id % 4 IN (0, 3) AS same FROM e""")
def same_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 37: properties against themselves with fields swapped, as text, with a field more, and with other white space."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    own = F.concat(F.lit('{"a": '), k, F.lit(', "b": ['), i, F.lit(", null]}"))
    other = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"b": ['), i, F.lit(', null], "a": '), k, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": "'), k, F.lit('", "b": ['), i, F.lit(", null]}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"a": '), k, F.lit(', "c": 1, "b": ['), i, F.lit(", null]}"))).otherwise(F.regexp_replace(own, " ", "\n  "))
    )
    return table(spark, sf_dir, "events").select("event_id", policy.same_json(own, other).alias("same"))


@query(f"""WITH {MESSAGES}, f AS (SELECT conv_id, coalesce(max(turn) FILTER (contains(text, '?')), -1) + 1 AS frozen FROM messages GROUP BY 1),
u AS (SELECT conv_id, max(turn) AS turn FROM messages WHERE role = 'user' GROUP BY 1)
SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes FROM messages JOIN u USING (conv_id, turn) JOIN f USING (conv_id) WHERE turn >= frozen AND strlen(text) >= 100 AND role = 'user'""")
def live_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 61, 62: messages with a question mark are taken for marked ones."""
    m = messages(spark, sf_dir)
    floors = policy.frozen_floor(m, "conv_id", "turn", F.col("text").contains("?"))
    return policy.live_zone(m, floors, "conv_id", "turn", "text", 100).select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))


@query(f"""WITH {MESSAGES} SELECT conv_id, least(coalesce(min(turn) FILTER (tokens > 100), count(*)), count(*) - 1) AS frozen FROM messages GROUP BY 1""")
def stable_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 61: messages of over 100 tokens are taken for unstable ones."""
    return policy.stable_prefix(messages(spark, sf_dir), "conv_id", "turn", F.col("tokens") <= 100)


@query("""SELECT event_id, event_id % 8 IN (0, 3, 4, 6) AS reads FROM events""")
def read_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 67: eight forms of command around every event's name."""
    forms = ["cd /x && cat %s.py", "cat %s.py > y", "grep x %s.py", "sudo head -n 3 %s.py", "sed -n '1,5p' %s.py", "sed s/a/b/ %s.py", "A=1 timeout 5 tail %s.log", "cat %s/yarn.lock"]
    command = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        command = F.when(F.col("event_id") % 8 == i, F.format_string(form, "event_type")).otherwise(command)
    return table(spark, sf_dir, "events").select("event_id", policy.reads_file(command).alias("reads"))


@query("""WITH l AS (SELECT * FROM conversations JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) USING (conv_id, turn))
SELECT conv_id, CASE WHEN bool_and(role = 'user') THEN CASE WHEN bool_or(length(text) % 3 = 0) THEN 'new_ask' WHEN bool_or(length(text) % 3 = 1) THEN 'error_continuation' ELSE 'continuation' END ELSE 'unknown' END AS kind FROM l GROUP BY 1""")
def turn_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 73: a third of the messages taken for text, the others for results, half of them errors."""
    n = F.length("text") % 3
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(n == 0, "text").otherwise("tool_result").alias("kind"), (n == 1).alias("is_error"))
    return policy.turn_kinds(blocks, "conv_id", "turn")


@query("""WITH c AS (SELECT p_brand, p_partkey, p_name || ' --size ' || p_size AS command, p_size % 2 = 0 AS failed, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
h AS (SELECT s.p_brand, s.p_partkey, f.p_partkey AS corrects FROM c s JOIN c f ON s.p_brand = f.p_brand AND f.r BETWEEN s.r - 5 AND s.r - 1 WHERE NOT s.failed AND f.failed AND s.command <> f.command AND string_split(s.command, ' ')[1] = string_split(f.command, ' ')[1]
 AND (levenshtein(s.command, f.command) <= 0.4 * greatest(length(s.command), length(f.command)) OR (length(string_split(s.command, ' ')[2]) >= 5 AND string_split(s.command, ' ')[2] = string_split(f.command, ' ')[2])))
SELECT p_brand, p_partkey, max(corrects) AS corrects FROM h GROUP BY ALL""")
def corrected_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 86: names of parts as commands, those of even size failed."""
    calls = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat("p_name", F.lit(" --size "), F.col("p_size").cast("string")).alias("command"), (F.col("p_size") % 2 == 0).alias("failed"))
    return policy.retries(calls, "p_brand", "p_partkey")


@query(f"""WITH {MESSAGES} SELECT conv_id, CAST(coalesce(sum(tokens) FILTER (role = 'system'), 0) AS BIGINT) AS system, CAST(coalesce(sum(tokens) FILTER (role = 'user'), 0) AS BIGINT) AS "user", CAST(coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant FROM messages GROUP BY 1""")
def block_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 99."""
    return policy.block_tokens(messages(spark, sf_dir).withColumn("kind", F.col("role")), "conv_id", ["system", "user", "assistant"])


@query(f"""WITH {REQUESTS}, b AS (SELECT instance, CAST(sum(after) AS BIGINT) // 1000 AS cost, CAST(sum(before - after) AS BIGINT) AS saved FROM requests GROUP BY 1) SELECT * FROM b ORDER BY cost DESC, saved DESC, instance""")
def ranked_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 106."""
    b = requests(spark, sf_dir).groupBy("instance").agg(F.floor(F.sum("after") / 1000).cast("long").alias("cost"), F.sum(F.col("before") - F.col("after")).alias("saved"))
    return policy.ranked(b, "instance")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS saved, CAST(floor(o_totalprice) AS BIGINT) % 900 AS cost FROM orders), r AS (SELECT *, sum(cost) OVER (PARTITION BY o_custkey ORDER BY saved DESC, o_orderkey) + 50 AS upto, row_number() OVER (PARTITION BY o_custkey ORDER BY saved DESC, o_orderkey) AS best FROM s)
SELECT o_custkey, o_orderkey, saved, cost FROM r WHERE upto <= 2000 OR best = 1""")
def capped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 186."""
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("saved"), (F.floor("o_totalprice").cast("long") % 900).alias("cost"))
    return policy.capped(s, "o_custkey", "o_orderkey", 2000, 50)


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_partkey IS NOT NULL)""")
def candidates_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 194: parts that were never sent back in large numbers."""
    kept = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return policy.others(table(spark, sf_dir, "part").select("p_partkey"), kept, "p_partkey")


@query("""WITH n AS (SELECT s_suppkey AS place, 'Nation ' || s_nationkey AS heading FROM supplier), p AS (SELECT c_custkey AS place, ' nation-' || c_nationkey AS heading, c_nationkey AS k FROM customer)
SELECT place, heading, false AS carried FROM n UNION ALL SELECT min(place), any_value(heading), true FROM p WHERE k NOT IN (SELECT s_nationkey FROM supplier) GROUP BY k""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 199: headings differ in case and signs only."""
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("heading"))
    prior = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.concat(F.lit(" nation-"), F.col("c_nationkey").cast("string")).alias("heading"))
    return policy.merged_sections(new, prior, F.col("heading"))
