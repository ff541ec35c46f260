"""Queries of what is learnt of tools, sessions and texts, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import shapes
from tokenloom.operators import rates, tools
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import REQUESTS, requests, table


def _compressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as compressions; those of a high value were fetched back, those of a higher one as a whole."""
    return requests(spark, sf_dir).withColumns({"retrieved": F.col("value") > 60, "full": F.col("value") > 70, "day": F.to_date("ts")})


_COMPRESSIONS = REQUESTS + """, compressions AS (SELECT *, value > 60 AS retrieved, value > 70 AS "full", CAST(ts AS DATE) AS day FROM requests)"""
_PATTERNS = _COMPRESSIONS + """, patterns AS (SELECT mode, model, count(*) AS samples, sum(before) AS before, sum(after) AS after, avg(before) AS mean_before, count(*) FILTER (retrieved) AS retrievals, count(*) FILTER (retrieved AND "full") AS full_retrievals, count(DISTINCT instance) AS users FROM compressions GROUP BY ALL)"""


@query(f"""WITH {_PATTERNS} SELECT mode, model, samples, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, round(mean_before, 6) AS mean_before, retrievals, full_retrievals, users FROM patterns""")
def tool_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 121, 122."""
    return tools.patterns(_compressions(spark, sf_dir), ["mode", "model"]).withColumn("mean_before", F.round("mean_before", 6))


@query(f"""WITH {_COMPRESSIONS}, p AS (SELECT model, day, count(*) AS n, sum(before) AS before, sum(after) AS after, count(*) FILTER (retrieved) AS r, count(*) FILTER (retrieved AND "full") AS f, count(DISTINCT instance) AS u FROM compressions GROUP BY ALL)
SELECT model, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(r) AS BIGINT) AS retrievals, CAST(sum(f) AS BIGINT) AS full_retrievals, round(sum(before) / sum(n), 6) AS mean_before, max(u) AS users FROM p GROUP BY 1""")
def merged_tool_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 125: the patterns of all days, merged."""
    c = tools.patterns(_compressions(spark, sf_dir), ["model", "day"]).drop("day")
    return tools.merged_patterns(c, by=["model"]).withColumn("mean_before", F.round("mean_before", 6))


@query(f"""WITH {_PATTERNS} SELECT mode, model, retrievals * 2 > samples AND full_retrievals > 0.8 * retrievals AS skip,
CAST(CASE WHEN retrievals * 2 > samples AND full_retrievals > 0.8 * retrievals THEN before // samples WHEN retrievals * 2 > samples THEN 50 WHEN retrievals * 5 > samples THEN 30 ELSE 20 END AS BIGINT) AS max_items,
round(least(0.95, least(0.7, samples / 100) + CASE WHEN users >= 3 THEN least(0.3, users * 0.03) ELSE 0 END), 6) AS confidence FROM patterns""")
def tool_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 123, 124."""
    p = tools.recommendations(tools.patterns(_compressions(spark, sf_dir), ["mode", "model"]), F.col("before"))
    return p.select("mode", "model", "skip", "max_items", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_COMPRESSIONS}, p AS (SELECT instance, count(*) AS n, count(*) FILTER (retrieved) AS r, count(*) FILTER (retrieved AND "full") AS f FROM compressions GROUP BY 1), s AS (SELECT *, r * 2 > n AND f > 0.8 * r AS s FROM p)
SELECT instance, n >= 5 AND s AS skip, CASE WHEN n < 5 OR s THEN NULL WHEN r * 2 > n THEN 50 WHEN r * 5 > n THEN 30 ELSE 15 END AS max_items, CASE WHEN n < 5 OR s THEN NULL WHEN r * 2 > n THEN 40 WHEN r * 5 > n THEN 25 ELSE 10 END AS suggested,
CASE WHEN n < 5 OR s THEN NULL WHEN r * 2 > n THEN 0.3 WHEN r * 5 > n THEN 0.5 ELSE 0.7 END AS aggressiveness FROM s""")
def tool_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 127."""
    return tools.hints(tools.patterns(_compressions(spark, sf_dir), ["instance"])).select("instance", "skip", "max_items", "suggested", "aggressiveness")


_RATES = REQUESTS + """, v AS (SELECT *, 's' || (instance % 3) AS strategy, CASE WHEN value > 97 THEN 'full' WHEN value > 90 THEN 'retrieve' ELSE 'compress' END AS kind FROM requests),
f AS (SELECT mode, model, strategy, min((ts, id)) FILTER (kind = 'compress') AS first_ FROM v GROUP BY ALL),
d AS (SELECT v.mode, v.model, v.strategy, list(CASE kind WHEN 'full' THEN CAST(-0.15 AS DOUBLE) WHEN 'retrieve' THEN CAST(-0.05 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END ORDER BY ts, id) FILTER ((ts, id) > first_) AS moves
  FROM v JOIN f ON f.mode = v.mode AND f.model = v.model AND f.strategy = v.strategy WHERE first_ IS NOT NULL GROUP BY ALL),
rates AS (SELECT mode, model, strategy, list_reduce(list_prepend(CAST(1 AS DOUBLE), coalesce(moves, [])), lambda x, m: greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), x + m))) AS rate FROM d)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as compressions by three strategies, some of them fetched back."""
    r = requests(spark, sf_dir).withColumn("strategy", F.concat(F.lit("s"), (F.col("instance") % 3).cast("string")))
    kind = F.when(F.col("value") > 97, "full").when(F.col("value") > 90, "retrieve").otherwise("compress")
    return rates.strategy_rates(r, ["mode", "model"], "strategy", "ts", "id", kind)


@query(f"""WITH {_RATES} SELECT mode, model, strategy, round(rate, 6) AS rate FROM rates""")
def strategy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 121, 122: the rates of strategies after all events in order."""
    return _rates(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_RATES} SELECT mode, model, arg_min(strategy, (-round(rate, 9), strategy)) AS best, round(max(rate), 6) AS rate FROM rates GROUP BY ALL""")
def best_rated_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 123."""
    return rates.best_strategies(_rates(spark, sf_dir), ["mode", "model"], "strategy").withColumn("rate", F.round("rate", 6))


@query("""WITH f AS (SELECT c_mktsegment AS tool, 'nation' || c_nationkey AS field, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY n DESC, field) AS p FROM f) SELECT tool, list(field ORDER BY p) AS fields FROM r WHERE p <= 5 GROUP BY 1""")
def fetched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 122, 123: the five fields asked for most."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tool"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("field"))
    return tools.top_fields(c, "tool", "field")


@query(f"""WITH {_PATTERNS} SELECT r.id, r.mode, r.model, p.samples FROM requests r LEFT JOIN (SELECT * FROM patterns WHERE retrievals * 5 > samples) p ON p.mode = r.mode AND p.model = r.model""")
def recommendation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 93."""
    known = tools.patterns(_compressions(spark, sf_dir), ["mode", "model"]).where("retrievals * 5 > samples").select("mode", "model", "samples")
    return tools.looked_up(requests(spark, sf_dir).select("id", "mode", "model"), known, ["mode", "model"])


@query(f"""WITH {REQUESTS}, s AS (SELECT instance, CAST(sum(after) AS BIGINT) AS tokens, CAST(sum(before - after) AS BIGINT) AS saved FROM requests GROUP BY 1)
SELECT *, CASE WHEN saved + tokens > 0 THEN round(100.0 * saved / (saved + tokens), 2) ELSE 0 END AS percent, CAST(row_number() OVER (ORDER BY saved DESC, instance) AS INTEGER) AS rank FROM s""")
def project_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 109."""
    return tools.snapshot(requests(spark, sf_dir), "instance")


@query("""SELECT l_linestatus AS provider, CAST(sum(CAST(floor(l_quantity) AS BIGINT) * (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)) AS BIGINT) AS read, CAST(sum(l_linenumber) AS BIGINT) AS written, round(100.0 * count(*) FILTER (l_returnflag = 'N' AND floor(l_quantity) > 0) / count(*), 2) AS hit_percent,
round(sum(CAST(floor(l_quantity) AS BIGINT) * (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)) * CAST(0.9 AS DOUBLE) - sum(l_linenumber) * CAST(0.25 AS DOUBLE), 4) AS net FROM lineitem GROUP BY 1""")
def prefix_cache_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 112."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("provider"), F.when(F.col("l_returnflag") == "N", F.floor("l_quantity").cast("long")).otherwise(0).alias("cache_read"), F.col("l_linenumber").alias("cache_write"))
    return tools.prefix_cache(li, "provider", 0.9, 0.25)


@query(f"""WITH {REQUESTS} SELECT model, mode, count(*) AS requests, CAST(sum(before) AS BIGINT) AS tokens, min(value) AS min_latency, max(value) AS max_latency, round(sum(value), 4) AS sum_latency FROM requests GROUP BY ALL""")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 113, 114, 119."""
    return tools.counters(requests(spark, sf_dir), ["model", "mode"], "value").withColumn("sum_latency", F.round("sum_latency", 4))


_STAGES = "SELECT l_orderkey * 10 + l_linenumber AS id, stage, seconds FROM (SELECT l_orderkey, l_linenumber, unnest(['parse', 'route', 'pack']) AS stage, unnest([l_quantity, l_discount * 300, l_tax * 500]) AS seconds FROM lineitem)"


@query(f"""WITH s AS ({_STAGES}) SELECT stage, count(*) AS n, round(avg(seconds), 6) AS mean, round(max(seconds), 6) AS most, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM s GROUP BY 1""")
def stage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 117: of all requests' stages."""
    return tools.stage_overhead(_staged(spark, sf_dir), "stages", "id")[0].withColumns({c: F.round(c, 6) for c in ("mean", "most", "p95")})


@query(f"""WITH s AS ({_STAGES}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seconds DESC, stage DESC) AS p FROM s) SELECT id, stage, round(seconds, 6) AS seconds FROM r WHERE p = 1""")
def slowest_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 117: the slowest stage of each request."""
    return tools.stage_overhead(_staged(spark, sf_dir), "stages", "id")[1].withColumn("seconds", F.round("seconds", 6))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    seconds = F.create_map(F.lit("parse"), F.col("l_quantity").cast("double"), F.lit("route"), F.col("l_discount").cast("double") * 300, F.lit("pack"), F.col("l_tax").cast("double") * 500)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), seconds.alias("stages"))


@query(f"""WITH {REQUESTS} SELECT id, model, before - after AS value FROM requests ORDER BY value DESC, id LIMIT 20""")
def top_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 172: the twenty requests that saved most, a report."""
    return tools.top_by(requests(spark, sf_dir), F.col("before") - F.col("after"), "id", 20).select("id", "model", "value")


@query("""SELECT source, lang, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(doc_id % 7) AS BIGINT) AS hits, round(CASE WHEN sum(doc_id % 7) + sum(doc_id % 3) > 0 THEN sum(doc_id % 7) / (sum(doc_id % 7) + sum(doc_id % 3)) ELSE 0 END, 6) AS hit_rate, count(*) FILTER (n_chars > 5000) AS evictions FROM documents GROUP BY ALL""")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 139, 140."""
    d = table(spark, sf_dir, "documents").select("source", "lang", F.col("n_chars").alias("bytes"), (F.col("doc_id") % 7).alias("hits"), (F.col("doc_id") % 3).alias("misses"), (F.col("n_chars") > 5000).alias("evicted"))
    return tools.cache_stats(d, ["source", "lang"])


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS r FROM events) SELECT event_id, user_id, event_type FROM c WHERE r > 1 AND NOT value > 90""")
def reissued_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 152: calls whose result is large are counted as such."""
    return tools.reissued(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "props", F.col("value") > 90).select("event_id", "user_id", "event_type")


@query(f"""WITH {REQUESTS}, g AS (SELECT instance, k * 10 AS words, date_diff('second', ts, lead(ts) OVER (PARTITION BY instance ORDER BY ts, id)) AS gap FROM requests) SELECT instance, count(*) FILTER (words >= 300) AS long, count(*) FILTER (words >= 300 AND gap < 300.0 * words / 230 * 60) AS skipped FROM g GROUP BY 1""")
def fast_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 135, 168: gaps are days here, so the part of the reading time is large."""
    w = Window.partitionBy("instance").orderBy("ts", "id")
    gap = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    r = requests(spark, sf_dir).select("instance", (F.col("k") * 10).alias("words"), gap.alias("gap"))
    return tools.fast_skips(r, "instance", "id", F.col("words"), F.col("gap"), 300, part=300.0)


@query("""WITH s AS (SELECT source, doc_id, n_chars % 100 / 100.0 * (1 - 0.5 * (doc_id % 50) / 40.0) AS s FROM documents WHERE doc_id % 50 <= 40), r AS (SELECT source, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM s WHERE s >= 0.3) SELECT * FROM r WHERE rank <= 3""")
def context_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 192."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 100 / 100.0).alias("relevance"), (F.col("doc_id") % 50).alias("age"))
    return tools.expansions(d, "source", "doc_id", F.col("age"), 40.0, 0.3, 3).select("source", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH u AS (SELECT 0 AS rank, 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 1, 'c' || (conv_id * 1000 + turn), text FROM conversations), h AS (SELECT substr(sha256(coalesce(text, '')), 1, 16) AS hash, rank, id FROM u)
SELECT hash, count(*) AS copies, min(rank) AS rank, arg_min(id, (rank, id)) AS id FROM h GROUP BY 1""")
def merged_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 198: documents and turns, one for each content."""
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("rank"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit(1).alias("rank"), F.concat(F.lit("c"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("id"), "text")
    return tools.by_content(d, c, content="text", rank="rank").select("hash", "copies", "rank", "id")


@query("""WITH p AS (SELECT substr(sha256('c' || o_custkey), 1, 16) AS hash, max(CAST(o_orderdate AS TIMESTAMP)) AS put_at, 86400 * 400 AS ttl FROM orders GROUP BY 1), g AS (SELECT substr(sha256('c' || o_custkey), 1, 16) AS hash, CAST(o_orderdate AS TIMESTAMP) AS got FROM orders),
f AS (SELECT p.hash, count(*) AS n FROM p JOIN g USING (hash) WHERE got >= put_at AND got < put_at + ttl * INTERVAL 1 SECOND GROUP BY 1)
SELECT p.hash, coalesce(n, 0) AS fetched, put_at + ttl * INTERVAL 1 SECOND > TIMESTAMP '1999-01-01' AS alive FROM p LEFT JOIN f USING (hash)""")
def store_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 355."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("content"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit(86400 * 400).alias("ttl"))
    gets = o.select(F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("at").alias("got"))
    return tools.stored(o, gets, F.to_timestamp(F.lit("1999-01-01")))


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def left_after_clearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 342."""
    return tools.cleared(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("""WITH m AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders) SELECT m.id, CASE WHEN n.prior = m.id THEN m.next END AS next FROM m LEFT JOIN m n ON n.id = m.next""")
def detached_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 341."""
    o = table(spark, sf_dir, "orders")
    by_id, by_date = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = o.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(by_id).alias("next"), F.lag("o_orderkey").over(by_date).alias("prior"))
    return tools.detached(m, "id", "next", "prior").select("id", "next")


@query(f"""WITH {REQUESTS} SELECT model, time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') AS start, CAST(sum(before - after) AS BIGINT) AS saved FROM requests GROUP BY ALL""")
def window_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 453."""
    r = requests(spark, sf_dir).withColumns({"saved": F.col("before") - F.col("after"), "at": F.col("ts").cast("timestamp")})
    return tools.window_contribution(r, "model", "at", "saved", "5 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) * 1000 AS "limit", CAST(floor(c_acctbal) AS DOUBLE) AS tokens, c_custkey % 200 AS reported FROM customer), d AS (SELECT *, tokens / "limit" * 100 AS e FROM w WHERE "limit" > 0 AND tokens > 0)
SELECT id, round(e, 6) AS expected, round(reported - e, 6) AS delta, CASE WHEN reported - e < 30 THEN 'warning' ELSE 'alert' END AS severity FROM d WHERE reported - e > 15""")
def quota_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 137."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey").cast("double") * 1000).alias("limit"), F.floor("c_acctbal").cast("double").alias("tokens"), (F.col("c_custkey") % 200).alias("reported"))
    return tools.discrepancies(c, digits=6).select("id", "expected", "delta", "severity")


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 443."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT l_returnflag AS flag, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 4) AS deviation, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem GROUP BY 1""")
def number_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 148, 149: linear percentiles, sample variance."""
    x = F.col("l_extendedprice").cast("double")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return li.agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.var_samp(x), 2).alias("variance"), F.round(F.stddev_samp(x), 4).alias("deviation"), F.round(F.percentile(x, 0.5), 4).alias("median"), F.round(F.percentile(x, 0.25), 4).alias("p25"), F.round(F.percentile(x, 0.75), 4).alias("p75"))


# columns over single texts and values ----------------------------------------------------------------------------

_NAMES = "CASE c_custkey % 5 WHEN 0 THEN 'claude-opus-4-' || c_nationkey WHEN 1 THEN 'gpt-5.' || c_nationkey || '-codex' WHEN 2 THEN 'claude-sonnet-4-20250514' WHEN 3 THEN 'gpt-4o' ELSE 'anthropic/claude-3-' || c_nationkey || '-haiku-20241022' END"


@query(f"""WITH m AS (SELECT c_custkey AS id, c_custkey % 5 AS k, c_nationkey AS n, {_NAMES} AS model FROM customer)
SELECT id, model, CASE k WHEN 0 THEN n >= 6 WHEN 1 THEN n >= 4 ELSE false END AS has_feature, CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 4 THEN 3 END AS INTEGER) AS major, CAST(CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 0 WHEN 4 THEN n END AS INTEGER) AS minor FROM m""")
def model_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 69, 326."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_NAMES).alias("model"))
    v = shapes.model_version(F.col("model"))
    return m.select("id", "model", shapes.has_feature(F.col("model")).alias("has_feature"), v["major"].alias("major"), v["minor"].alias("minor"))


@query("""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '[1, 2.5, ' || o_custkey || ']' WHEN 2 THEN '["a", "' || o_orderstatus || '"]' WHEN 3 THEN '[{"a": ' || o_custkey || '}, {}]' WHEN 4 THEN '[true, false]' WHEN 5 THEN '[[1], []]' ELSE '[1, "x", null]' END AS json FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN len(list_distinct(list_transform(json_extract(json, '$[*]'), lambda x: CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE json_type(x) END))) > 1 THEN 'mixed_array'
ELSE CASE json_type(json, '$[0]') WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'nested' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' ELSE 'number' END || '_array' END AS kind FROM a""")
def array_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 201."""
    json = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '[1, 2.5, ' || o_custkey || ']' WHEN 2 THEN '["a", "' || o_orderstatus || '"]' WHEN 3 THEN '[{"a": ' || o_custkey || '}, {}]' WHEN 4 THEN '[true, false]' WHEN 5 THEN '[[1], []]' ELSE '[1, "x", null]' END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.array_kind(json).alias("kind"))


@query("""SELECT c_custkey, '{"a":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS canonical, substr(sha256(c_mktsegment), 1, 8) AS hash FROM customer""")
def canonical_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 234."""
    c = table(spark, sf_dir, "customer")
    json = F.concat(F.lit('{ "segment" : "'), "c_mktsegment", F.lit('", "a": '), F.col("c_nationkey").cast("string"), F.lit(" }"))
    return c.select("c_custkey", shapes.canonical_json(json).alias("canonical"), shapes.field_hash(F.col("c_mktsegment")).alias("hash"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^#+[ \\t]+')) AS BIGINT) AS headers, CAST(len(regexp_extract_all(text, '(?m)^[ \\t]*[-*+][ \\t]+')) AS BIGINT) AS bullets, CAST(len(regexp_extract_all(text, '\\?')) AS BIGINT) AS questions, CAST(len(regexp_extract_all(text, '<[^>]+>')) AS BIGINT) AS tags, CAST(len(regexp_extract_all(text, '`[^`]+`')) AS BIGINT) AS inline_code FROM documents""")
def prompt_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 304."""
    found = shapes.structure_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(found[c].cast("long").alias(c) for c in ("headers", "bullets", "questions", "tags", "inline_code")))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark), u AS (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(w) AS x FROM w) GROUP BY ALL), s AS (SELECT item_id, count(*) AS v, count(*) FILTER (n = 1) AS once, sum(n * n) AS q, sum(n) AS n FROM u GROUP BY 1)
SELECT item_id, CAST(n AS INTEGER) AS words, CAST(v AS INTEGER) AS different, round(v / n, 6) AS ratio, CAST(once AS INTEGER) AS once, round(10000.0 * (q - n) / (n * n), 6) AS yule_k FROM s""")
def prompt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 303: of the prompts of the benchmark; a text without words has no row in either."""
    from tokenloom.functions.text import words

    b = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    s = shapes.word_statistics(F.col("w"))
    return b.select("item_id", s["words"].alias("words"), s["different"].alias("different"), F.round(s["ratio"], 6).alias("ratio"), s["once"].alias("once"), F.round(s["yule_k"], 6).alias("yule_k"))


@query("""WITH f AS (SELECT doc_id, text, list_distinct(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: length(x) > 8)) AS facts FROM documents) SELECT doc_id, round(CASE WHEN len(facts) > 0 THEN len(list_filter(facts, lambda x: contains(substr(text, 1, 1000), x))) / len(facts) ELSE 1 END, 6) AS recall FROM f WHERE text IS NOT NULL""")
def prefix_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 311: how many of a text's long words its first thousand characters hold."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    facts = F.array_distinct(F.filter(F.split("text", r"[ \n]+"), lambda x: F.length(x) > 8))
    return d.select("doc_id", F.round(shapes.recall_of(facts, F.substring("text", 1, 1000)), 6).alias("recall"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'make test' WHEN 1 THEN 'grep -n x f' || o_custkey WHEN 2 THEN 'cd d' || o_custkey ELSE 'cat a' END AS command FROM orders""")
def primary_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 313."""
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'make test 2>&1 | tail -20' WHEN 1 THEN 'grep -n x f' || o_custkey || ' | sort | uniq' WHEN 2 THEN 'cd d' || o_custkey || ' && ls -la' ELSE 'cat a 2>/dev/null' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.primary_command(raw).alias("command"))


@query("""SELECT l_orderkey, l_linenumber, round(((100 - l_linenumber) * 3.0 + l_linenumber * 0.3 + floor(l_quantity) * 15.0) / 1e6, 9) AS cost FROM lineitem""")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 322."""
    cost = shapes.estimated_cost(F.lit(100), F.floor("l_quantity"), F.col("l_linenumber"), F.lit(3.0), F.lit(15.0), F.lit(0.3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(cost, 9).alias("cost"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 3600 WHEN 1 THEN 300 ELSE coalesce(CASE WHEN o_custkey % 2 = 0 THEN 900 END, 300) END AS ttl, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS label FROM orders""")
def resolved_ttls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 413, 455."""
    explicit = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("5m"), F.lit("1h"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("5m")))
    learned = F.when(F.col("o_custkey") % 2 == 0, 900)
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.cache_ttl(explicit, learned).alias("ttl"), shapes.known_or_other(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("label"))
