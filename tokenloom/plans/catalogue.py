"""The registered queries of the operators, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import numbers, text
from tokenloom.operators import arrays, lines, memory, metrics, neighbours, ranking, sequences
from tokenloom.plans.inputs import BEACON, DOC_LINES, EDGES, LOG_LINES, MESSAGES, REQUESTS, beacon, doc_lines, edges, log_lines, messages, requests, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# context report -------------------------------------------------------------------------------------------------


@query(f"""WITH {MESSAGES}, hashed AS (SELECT conv_id, turn, role, tokens, substr(md5(text), 1, 16) AS hash FROM messages),
again AS (SELECT conv_id, turn, tokens, turn - lag(turn) OVER (PARTITION BY conv_id, hash ORDER BY turn) AS since FROM (SELECT conv_id, turn, hash, max(tokens) AS tokens FROM hashed GROUP BY ALL)),
waste AS (SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS reread FROM again WHERE since > 3 AND tokens >= 50 GROUP BY 1)
SELECT m.conv_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(tokens) FILTER (role = 'user'), 0) AS BIGINT) AS user_tokens,
       CAST(coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_tokens, coalesce(max(reread), 0) AS reread
FROM messages m LEFT JOIN waste USING (conv_id) GROUP BY m.conv_id ORDER BY tokens DESC, conv_id LIMIT 10""")
def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest conversations: tokens by role and those served again."""
    m = messages(spark, sf_dir)
    again = sequences.rereads(m.select("conv_id", "turn", text.short_hash(F.col("text")).alias("hash"), "tokens")).select("conv_id", F.col("tokens").alias("reread"))
    part = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("tokens"))), F.lit(0)).alias(f"{role}_tokens")
    each = m.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), part("user"), part("assistant"))
    return each.join(again, "conv_id", "left").withColumn("reread", F.coalesce("reread", F.lit(0))).orderBy(F.desc("tokens"), "conv_id").limit(10)


# metrics --------------------------------------------------------------------------------------------------------


@query(f"""WITH {REQUESTS} SELECT count(*) AS total_requests, CAST(sum(before) AS BIGINT) AS total_before, CAST(sum(after) AS BIGINT) AS total_after, CAST(sum(before - after) AS BIGINT) AS total_saved,
round(avg(before - after), 4) AS avg_saved, count(*) FILTER (mode = 'audit') AS audit_count, count(*) FILTER (mode = 'optimize') AS optimize_count FROM requests""")
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 95."""
    return metrics.summary(requests(spark, sf_dir))


@query(f"""WITH {REQUESTS} SELECT id, ts, model, before, after FROM requests WHERE model = 'view' AND mode = 'optimize' ORDER BY ts DESC, id LIMIT 50 OFFSET 20""")
def metrics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 33, 34, 171."""
    return metrics.page(metrics.filtered(requests(spark, sf_dir), model="view", mode="optimize"), 50, 20).select("id", "ts", "model", "before", "after")


@query(f"""WITH {BEACON}, d AS (SELECT date_trunc('day', ts) AS bucket, instance, max(total) AS total FROM beacon GROUP BY ALL)
SELECT CAST(bucket AS TIMESTAMP) AS bucket, count(*) AS instances, CAST(sum(total) AS BIGINT) AS total FROM d GROUP BY bucket""")
def dashboard_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 100."""
    return metrics.beacon_rollup(beacon(spark, sf_dir), "day", ["total"])


@query(f"""WITH {BEACON}, d AS (SELECT date_trunc('hour', ts) AS bucket, instance, max(total) AS total FROM beacon WHERE ts > (SELECT max(ts) FROM beacon) - INTERVAL 48 HOUR GROUP BY ALL)
SELECT CAST(bucket AS TIMESTAMP) AS bucket, count(*) AS instances, CAST(sum(total) AS BIGINT) AS total FROM d GROUP BY bucket""")
def dashboard_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 101: the last 48 hours."""
    b = beacon(spark, sf_dir)
    recent = b.crossJoin(F.broadcast(b.agg(F.max("ts").alias("last")))).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 48 HOURS"))
    return metrics.beacon_rollup(recent, "hour", ["total"])


@query(f"""WITH {BEACON}, d AS (SELECT instance, date_trunc('day', ts) AS day, max(total) AS m FROM beacon GROUP BY ALL)
SELECT instance, CAST(sum(m) AS BIGINT) AS total, count(*) AS days FROM d GROUP BY instance ORDER BY total DESC, instance LIMIT 20""")
def top_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 102."""
    return metrics.top_instances(beacon(spark, sf_dir), "total")


def _rollup(unit: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.savings_rollup(beacon(spark, sf_dir), unit)

    run.__name__, run.__doc__ = f"savings_rollup_{unit}", "Row 108."
    query(f"""WITH {BEACON}, s AS (SELECT *, greatest(total - coalesce(lag(total) OVER (PARTITION BY instance ORDER BY ts, id), 0), 0) AS step FROM beacon)
    SELECT instance, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket, CAST(sum(step) AS BIGINT) AS saved, arg_max(total, (ts, id)) AS total FROM s GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2"))(run)


for _unit in ("hour", "day", "week", "month"):
    _rollup(_unit)


@query(f"""WITH {REQUESTS} SELECT model, mode, count(*) AS requests, CAST(sum(before - after) AS BIGINT) AS saved FROM requests GROUP BY GROUPING SETS ((), (model), (mode))""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 105, 115."""
    return metrics.ledger(requests(spark, sf_dir))


@query(f"""WITH {REQUESTS} SELECT model, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM requests GROUP BY model""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 116."""
    return metrics.latency(requests(spark, sf_dir), "value", "model")


@query(f"""WITH {REQUESTS} SELECT count(*) AS requests, CAST(coalesce(sum(before), 0) AS BIGINT) AS tokens, round(coalesce(sum(before), 0) / 86400.0, 4) AS tokens_per_s FROM requests WHERE ts > (SELECT max(ts) FROM requests) - INTERVAL 86400 SECOND""")
def throughput_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 118."""
    return metrics.throughput(requests(spark, sf_dir), 86400)


@query(f"""WITH {REQUESTS} SELECT model, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(value) AS le_inf FROM requests GROUP BY model""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 120."""
    return metrics.histogram(requests(spark, sf_dir), "value", [10, 50, 100], "model")


@query("""WITH o AS (SELECT o_orderpriority AS stratum, CASE WHEN o_custkey % 10 = 0 THEN 'control' ELSE 'treatment' END AS arm, o_totalprice AS tokens FROM orders),
a AS (SELECT stratum, count(*) FILTER (arm = 'control') AS cn, avg(tokens) FILTER (arm = 'control') AS cm, var_samp(tokens) FILTER (arm = 'control') AS cv,
      count(*) FILTER (arm = 'treatment') AS tn, avg(tokens) FILTER (arm = 'treatment') AS tm, var_samp(tokens) FILTER (arm = 'treatment') AS tv FROM o GROUP BY 1),
t AS (SELECT sum(tn * (cm - tm)) AS saved, sum(tn * cm) AS baseline, sum(tn * tn * (coalesce(cv, 0) / cn + coalesce(tv, 0) / tn)) AS v, CAST(sum(tn) AS BIGINT) AS requests FROM a WHERE cn > 0 AND tn > 0)
SELECT requests, round(saved, 2) AS saved, round(100 * saved / baseline, 6) AS pct, round(100 * (saved - 1.96 * sqrt(v)) / baseline, 6) AS low, round(100 * (saved + 1.96 * sqrt(v)) / baseline, 6) AS high FROM t""")
def savings_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 90, 129, 130."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), F.when(F.col("o_custkey") % 10 == 0, "control").otherwise("treatment").alias("arm"), F.col("o_totalprice").alias("tokens"))
    return metrics.holdout_savings(o)


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS stratum FROM orders),
n AS (SELECT o_orderstatus || '|' || o_orderpriority AS stratum, avg(o_totalprice) AS mean, min(o_orderkey) AS place, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT * FROM n WHERE n * 50 >= 49 * (SELECT max(n) FROM n)),
k AS (SELECT split_part(stratum, '|', 1) AS lead, arg_min(mean, place) AS kin FROM s GROUP BY 1)
SELECT r.o_orderkey, r.stratum, round(coalesce(s.mean, k.kin, (SELECT avg(mean) FROM s)), 4) AS baseline, CASE WHEN s.mean IS NOT NULL THEN 'exact' WHEN k.kin IS NOT NULL THEN 'lead' ELSE 'overall' END AS level
FROM r LEFT JOIN s USING (stratum) LEFT JOIN k ON k.lead = split_part(r.stratum, '|', 1)""")
def savings_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 91: strata nearly as large as the largest have a baseline."""
    o = table(spark, sf_dir, "orders").withColumn("stratum", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    n = o.groupBy("stratum").agg(F.avg("o_totalprice").alias("mean"), F.min("o_orderkey").alias("place"), F.count("*").alias("n"))
    s = n.withColumn("most", F.max("n").over(Window.partitionBy())).where("n * 50 >= 49 * most").drop("n", "most")  # a row a stratum
    return metrics.baseline_backoff(o.select("o_orderkey", "stratum"), s).withColumn("baseline", F.round("baseline", 4))


@query(f"""WITH {REQUESTS}, p(model, price) AS (VALUES ('view', 3.0), ('click', 0.8), ('purchase', 15.0)), each AS (SELECT date_trunc('month', ts) AS period, r.model, before * coalesce(p.price, 1.0) / 1e6 AS cost FROM requests r LEFT JOIN p ON p.model = r.model)
SELECT CAST(period AS TIMESTAMP) AS period, model, round(sum(cost), 6) AS cost FROM each GROUP BY 1, 2""")
def period_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 111, 136, 452."""
    prices = spark.createDataFrame([("view", 3.0), ("click", 0.8), ("purchase", 15.0), ("*", 1.0)], "model string, price double")
    return metrics.period_cost(requests(spark, sf_dir), prices, "month")


@query(f"""WITH {REQUESTS}, r AS (SELECT instance AS tool, model AS strategy, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate, min(id) AS first, count(*) AS n FROM requests GROUP BY ALL)
SELECT tool, arg_min(strategy, (rate, first)) AS strategy FROM r WHERE n >= 2 AND rate < 1 GROUP BY tool""")
def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 128."""
    r = requests(spark, sf_dir).select("id", F.col("instance").alias("tool"), F.col("model").alias("strategy"), (F.col("value") > 50).cast("double").alias("retrieved"))
    return metrics.best_strategy(r, 2)


@query(r"""WITH h AS (SELECT page_id, array_to_string(regexp_extract_all(html, '<[^>]+>'), '') AS tags FROM pages),
t AS (SELECT CASE WHEN tags = '' THEN 0 ELSE greatest(1, CAST(floor(length(tags) / 4.0 + 0.5) AS BIGINT)) END AS html_noise, greatest(1, CAST(floor(length(html) / 4.0 + 0.5) AS BIGINT)) AS tokens FROM pages JOIN h USING (page_id)),
s AS (SELECT CAST(sum(html_noise) AS BIGINT) AS a, CAST(sum(tokens) AS BIGINT) AS b FROM t), u AS (SELECT 'html_noise' AS kind, a AS tokens FROM s UNION ALL SELECT 'history_bloat', greatest(0, b - a) FROM s)
SELECT kind, tokens, round(100.0 * tokens / max(tokens) OVER (), 1) AS pct FROM u""")
def waste_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 97, 98."""
    p = table(spark, sf_dir, "pages").select(text.token_estimate(text.matched(F.col("html"), text.HTML_TAG)).alias("html_noise"), text.token_estimate(F.col("html")).alias("tokens"))
    return metrics.waste_histogram(p, ["html_noise"], "tokens")


@query(f"""WITH {REQUESTS}, b AS (SELECT id, before, CASE WHEN before < 2000 THEN 'xs' WHEN before < 8000 THEN 's' WHEN before < 32000 THEN 'm' WHEN before < 128000 THEN 'l' ELSE 'xl' END AS bucket FROM requests)
SELECT bucket, count(*) AS n, CAST(sum(CASE WHEN before < 1024 THEN 0 ELSE before // 128 * 128 END) AS BIGINT) AS cached FROM b GROUP BY 1""")
def input_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 170, 362."""
    return requests(spark, sf_dir).groupBy(numbers.input_bucket(F.col("before")).alias("bucket")).agg(F.count("*").alias("n"), F.sum(numbers.cached_prefix(F.col("before"))).alias("cached"))


@query("""SELECT c_custkey, CASE WHEN CAST('0x' || substr(sha256('arm:' || c_custkey), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 THEN 'control' ELSE 'treatment' END AS arm FROM customer""")
def holdout_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 468."""
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.holdout_arm(F.col("c_custkey").cast("string"), 0.2).alias("arm"))


# windows --------------------------------------------------------------------------------------------------------


@query(f"""WITH v AS (SELECT l_suppkey, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o, l_quantity AS v FROM lineitem),
w AS (SELECT l_suppkey, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, stddev_samp(v) OVER (PARTITION BY l_suppkey) AS sd,
      avg(v) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, avg(v) OVER (p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b FROM v WINDOW p AS (PARTITION BY l_suppkey ORDER BY o))
SELECT l_suppkey, list_reduce(list_prepend([-1000], list_transform(list_sort(list(i)), lambda x: [CAST(x AS INTEGER)])), lambda acc, x: CASE WHEN x[1] - acc[-1] > 5 THEN list_concat(acc, x) ELSE acc END)[2:] AS places
FROM w WHERE i >= 5 AND i < n - 5 AND sd > 0 AND abs(b - a) > 2 * sd GROUP BY 1""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 145."""
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("o"), "l_quantity")
    return sequences.change_points(v, "l_suppkey", "o", "l_quantity")


@query("""WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN s USING (l_suppkey) WHERE sd > 0 AND abs(l_extendedprice - m) > 1.65 * sd""")
def numeric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 146."""
    return sequences.anomalies(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", 1.65)


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM conversations),
p AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS pair FROM w),
f AS (SELECT conv_id, turn, count(*) AS fresh FROM (SELECT conv_id, pair, min(turn) AS turn FROM p GROUP BY ALL) GROUP BY ALL)
SELECT c.conv_id, c.turn, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS BIGINT) AS seen FROM conversations c LEFT JOIN f USING (conv_id, turn)""")
def bigram_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 153."""
    c = table(spark, sf_dir, "conversations")
    return sequences.bigram_curve(c, "conv_id", "turn", text.words(F.col("text")))


@query(f"""WITH c AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders),
r AS (SELECT o_custkey, y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER p AS n, min(y) OVER p AS low, max(y) OVER p AS high FROM c WINDOW p AS (PARTITION BY o_custkey)),
m AS (SELECT o_custkey, max(high > low) AS rises, max((CASE WHEN high > low THEN (y - low) / (high - low) - i / (n - 1) END)) AS lift, arg_max(i, (CASE WHEN high > low THEN (y - low) / (high - low) - i / (n - 1) END, -i)) AS i FROM r GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT rises THEN 1 WHEN lift >= 0.05 THEN i + 1 END AS knee FROM m""")
def spending_knees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 154."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    curve = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(w).alias("y"))
    return sequences.knee(curve, "o_custkey", "o_orderkey", "y")


@query(f"""WITH {MESSAGES}, s AS (SELECT conv_id, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM messages) SELECT conv_id, count(*) FILTER (s <= 300) AS frozen FROM s GROUP BY 1""")
def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 157."""
    return sequences.frozen_prefix(messages(spark, sf_dir), "conv_id", "turn", "tokens", F.lit(300))


@query(f"""WITH {MESSAGES}, s AS (SELECT conv_id, turn, tokens, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS suffix FROM messages)
SELECT conv_id, turn, tokens, suffix, round(tokens // 2 * CAST(1.65 AS DOUBLE) - CAST(0.575 AS DOUBLE) * (suffix + tokens // 2), 6) AS gain, round(CAST(11.5 AS DOUBLE) * suffix / nullif(tokens // 2, 0), 6) AS break_even FROM s""")
def net_cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 57, 59, 159."""
    s = sequences.suffix_tokens(messages(spark, sf_dir), "conv_id", "turn", "tokens")
    half = F.floor(F.col("tokens") / 2)
    return s.select("conv_id", "turn", "tokens", "suffix", F.round(numbers.net_gain(half, F.col("suffix"), 5.0, 0.5), 6).alias("gain"), F.round(numbers.break_even_reads(half, F.col("suffix")), 6).alias("break_even"))


@query(f"""WITH {REQUESTS}, w AS (SELECT id, instance, ts, k % 2 AS cached, model AS prefix, lag(ts) OVER p AS pt, lag(model) OVER p AS pp FROM requests WINDOW p AS (PARTITION BY instance ORDER BY ts, id))
SELECT id, instance, CASE WHEN pt IS NULL THEN 'cold_start' WHEN cached > 0 THEN 'hit' WHEN ts - pt > INTERVAL 86400 SECOND THEN 'ttl_expiry' WHEN pp <> prefix THEN 'prefix_change' ELSE 'unknown' END AS cause FROM w""")
def cache_miss_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 158."""
    r = requests(spark, sf_dir).select("id", "instance", "ts", (F.col("k") % 2).alias("cached"), F.col("model").alias("prefix"))
    return sequences.cache_misses(r, "instance", 86400).select("id", "instance", "cause")


@query(f"""WITH {LOG_LINES}, w AS (SELECT *, max(CASE WHEN line LIKE '%ERROR%' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM log_lines) SELECT log_id, n, line FROM w WHERE near = 1""")
def error_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 160, 164."""
    return sequences.around(log_lines(spark, sf_dir), "log_id", "n", F.col("line").contains("ERROR"), 2, 3)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (f = 1 OR b = 1) DESC, o_totalprice DESC, o_orderkey) AS r FROM e) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE r <= 5""")
def first_last_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 161, 163."""
    return sequences.first_last_best(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", 5)


@query("""WITH c AS (SELECT user_id AS session, event_id % 3 AS tool, event_id AS seq, event_type = 'error' AS is_error FROM events),
w AS (SELECT *, max(CASE WHEN is_error THEN seq END) OVER (PARTITION BY session, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_seq FROM c)
SELECT session, tool, seq, error_seq FROM w WHERE NOT is_error AND seq - error_seq <= 2000""")
def error_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 84."""
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("tool"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_error"))
    return sequences.recoveries(c, 2000)


@query("""WITH o AS (SELECT user_id AS session, event_id % 2 AS path, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'edit' ELSE 'read' END AS kind, CAST(floor(value) AS BIGINT) % 10 AS low, CAST(floor(value) AS BIGINT) % 10 + CAST(floor(value) AS BIGINT) % 7 AS high FROM events)
SELECT r.session, r.path, r.seq, CASE WHEN bool_or(l.kind = 'edit') THEN 'stale' WHEN bool_or(l.kind = 'read' AND l.low <= r.low AND l.high >= r.high) THEN 'superseded' ELSE 'fresh' END AS state
FROM o r LEFT JOIN o l ON l.session = r.session AND l.path = r.path AND l.seq > r.seq WHERE r.kind = 'read' GROUP BY ALL""")
def read_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 88."""
    v = F.floor("value").cast("long")
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 2).alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "edit").otherwise("read").alias("kind"), (v % 10).alias("low"), (v % 10 + v % 7).alias("high"))
    return sequences.read_lifecycle(o)


@query("""WITH c AS (SELECT user_id AS session, event_type || ':' || event_id % 2 AS signature, event_type = 'error' AS is_error, CAST(floor(value) AS BIGINT) AS bytes FROM events),
e AS (SELECT session, signature, count(*) AS n, count(*) FILTER (is_error) AS errors, sum(bytes) AS b, max(bytes) AS m FROM c GROUP BY ALL HAVING count(*) >= 2)
SELECT signature, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(CASE WHEN errors >= n / 2 THEN b ELSE b - m END) AS BIGINT) AS wasted FROM e GROUP BY 1""")
def call_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 131."""
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.concat_ws(":", "event_type", (F.col("event_id") % 2).cast("string")).alias("signature"), (F.col("event_type") == "error").alias("is_error"), F.floor("value").cast("long").alias("bytes"))
    return sequences.loops(c, 2)


@query(f"""WITH {REQUESTS} SELECT id, instance, coalesce(model <> lag(model) OVER p, false) AS model_changed, coalesce(mode <> lag(mode) OVER p, false) AS mode_changed FROM requests WINDOW p AS (PARTITION BY instance ORDER BY id)""")
def prefix_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 364."""
    return sequences.drift(requests(spark, sf_dir), "instance", "id", "model", "mode").select("id", "instance", "model_changed", "mode_changed")


@query("""WITH p AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS us FROM events)
SELECT user_id, round(quantile_cont(us / 1e6, 0.5), 6) AS median_pause, count(*) FILTER (us > 300000000) AS over_5m, count(*) FILTER (us > 3600000000) AS over_1h FROM p GROUP BY 1""")
def activity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 167."""
    return sequences.gaps(table(spark, sf_dir, "events"), "user_id", "ts", {"over_5m": 300, "over_1h": 3600})


# ranking --------------------------------------------------------------------------------------------------------

_BM25 = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
tf AS (SELECT doc_id, len_ AS len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len_, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 260, 262, 265."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return neighbours.bm25_best(table(spark, sf_dir, "documents"), q, 10)


_COS = """c AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE q.vec_id <> e.vec_id)"""


@query(f"""WITH {_COS}, r AS (SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM c WHERE s >= 0.1) SELECT * FROM r WHERE rank <= 10""")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 81, 187: every fiftieth vector against all."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e, e.where("vec_id % 50 = 0"), 10, 0.1).withColumn("similarity", F.round("similarity", 6))


def vector_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 188: the same by random projections."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearly_nearest(e, e.where("vec_id % 50 = 0"), 10, 0.1).withColumn("similarity", F.round("similarity", 6))


QUERIES["vector_ann"] = vector_ann

_HASHES = "SELECT *, 'h' || (vec_id * 7 % 9973) AS asked, 'h' || (vec_id * 11 % 9973) AS kept FROM embeddings"


@query(f"""WITH e AS ({_HASHES}), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
hit AS (SELECT q.vec_id, min(e.vec_id) AS entry FROM q JOIN e ON e.kept = q.asked AND e.vec_id <> q.vec_id GROUP BY 1),
s AS (SELECT q.vec_id, e.vec_id AS entry, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM q, e WHERE e.vec_id <> q.vec_id AND q.vec_id NOT IN (SELECT vec_id FROM hit)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, entry) AS p FROM s WHERE s >= 0.35) WHERE p = 1)
SELECT q.vec_id, coalesce(hit.entry, near.entry) AS entry, round(near.s, 6) AS similarity FROM q LEFT JOIN hit ON hit.vec_id = q.vec_id LEFT JOIN near ON near.vec_id = q.vec_id""")
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 358: every fiftieth vector asks a cache of all, by a hash that some entries have, then by meaning."""
    e = table(spark, sf_dir, "embeddings")
    hashed = lambda df, m: df.select("vec_id", F.concat(F.lit("h"), (F.col("vec_id") * m % 9973).cast("string")).alias("hash"), "embedding")
    return neighbours.cached(hashed(e.where("vec_id % 50 = 0"), 7), hashed(e, 11), 0.35).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_BM25}, b AS (SELECT query_id, max(score) AS best FROM bm GROUP BY 1), t AS (SELECT query_id, doc_id, score / best AS t FROM bm JOIN b USING (query_id)),
v AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS v FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND q.vec_id <> e.vec_id AND list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) >= 0.1),
h AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.doc_id, t.doc_id) AS doc_id, 0.7 * coalesce(v, 0) + 0.3 * coalesce(t, 0) AS s FROM v FULL JOIN t ON v.query_id = t.query_id AND v.doc_id = t.doc_id),
r AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM h) SELECT * FROM r WHERE rank <= 10""")
def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 82: all vectors and texts, merged; the table's vectors stand for the documents and items of their ids."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return neighbours.hybrid_best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), q, 10, 0.1)


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END, 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def turn_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 197."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.words(F.col("text"))).alias("w"))
    return c.withColumn("b", F.lag("w").over(w)).where("b IS NOT NULL").select("conv_id", "turn", F.round(ranking.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), k AS (SELECT conv_id * 1000 + turn AS k, text, b FROM p WHERE b IS NOT NULL),
x AS (SELECT k, w, count(*) AS a FROM (SELECT k, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM k) GROUP BY ALL), y AS (SELECT k, w, count(*) AS b FROM (SELECT k, unnest(regexp_extract_all(lower(b), '[a-z0-9_]+')) AS w FROM k) GROUP BY ALL),
s AS (SELECT k, sum(least(a, b)) AS s FROM x JOIN y USING (k, w) GROUP BY 1)
SELECT k, round(CASE WHEN n = 0 THEN 1 ELSE 2.0 * coalesce(s, 0) / n END, 6) AS f1 FROM (SELECT k, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) + len(regexp_extract_all(lower(b), '[a-z0-9_]+')) AS n FROM k) LEFT JOIN s USING (k)""")
def turn_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 196, 309."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", F.lag("text").over(w).alias("b")).where("b IS NOT NULL")
    return ranking.bag_f1(c, "k", F.col("text"), F.col("b")).select("k", F.round("f1", 6).alias("f1"))


@query("""WITH v AS (SELECT l_suppkey, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER a AS n1, sum(n * v) OVER a AS s1, lead(v) OVER w AS nx FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY v), a AS (PARTITION BY l_suppkey)),
c AS (SELECT l_suppkey, (v + nx) / 2 AS cut, round(CAST(n0 AS DOUBLE) * (n1 - n0) * pow(s0 / n0 - (s1 - s0) / (n1 - n0), 2), 6) AS spread FROM r WHERE nx IS NOT NULL)
SELECT l_suppkey, arg_max(cut, (spread, -cut)) AS cut FROM c GROUP BY 1""")
def otsu_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 268."""
    return ranking.otsu(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


# arrays ---------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_custkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_orderkey']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR)]) AS value FROM orders)
SELECT o_custkey, field, count(*) AS n, count(DISTINCT coalesce(value, 'None')) AS "distinct", round(count(DISTINCT coalesce(value, 'None')) / count(*), 6) AS uniqueness, count(DISTINCT coalesce(value, 'None')) = 1 AS constant, round(avg(length(coalesce(value, 'None'))), 6) AS mean_length FROM l GROUP BY ALL""")
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 207."""
    o = table(spark, sf_dir, "orders")
    return arrays.field_stats(arrays.long_form(o, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_orderkey"]), "o_custkey")


@query("""WITH e AS (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS run, row_number() OVER w AS place, count(*) OVER () AS kinds, sum(n) OVER () AS total FROM e WINDOW w AS (ORDER BY n DESC, v)),
k AS (SELECT *, min(CASE WHEN run >= ceil(total * 0.8) THEN place END) OVER () AS needed FROM r) SELECT v AS l_linenumber, n FROM k WHERE kinds BETWEEN 2 AND 50 AND needed <= 6 AND place > needed""")
def rare_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 219."""
    return arrays.rare_values(table(spark, sf_dir, "lineitem"), "l_linenumber", top=6)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM r WHERE n = 1""")
def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 183."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return arrays.deduplicated(o, "o_custkey", "o_orderkey", arrays.item_hash(F.col("o_orderstatus"), F.col("o_orderpriority")))


@query("""WITH c AS (SELECT source, doc_id, substr(md5(substr(text, 1, 50)), 1, 8) AS cluster FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, cluster ORDER BY doc_id) AS n FROM c) SELECT source, doc_id, cluster FROM r WHERE n <= 2""")
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 175."""
    return arrays.cluster_sample(table(spark, sf_dir, "documents"), "source", "doc_id", F.col("text")).select("source", "doc_id", "cluster")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY i % greatest(1, n // 4), i) AS r FROM p) SELECT o_custkey, o_orderkey FROM r WHERE r <= 4""")
def stride_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 178."""
    return arrays.stride_fill(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice > 300000 AS INTEGER) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, (f <= 3) DESC, (b <= 2) DESC, o_orderkey) AS r FROM p) SELECT o_custkey, o_orderkey FROM r WHERE c = 1 OR r <= 6""")
def priority_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 179."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return arrays.priority_keep(o, "o_custkey", "o_orderkey", F.col("o_totalprice") > 300000, 6).drop("o_totalprice")


@query("""WITH d AS (SELECT l_suppkey, l_discount * 100 AS v, CASE WHEN l_discount <= lag(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) THEN 1.0 ELSE 0.0 END AS down, lag(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) IS NULL AS first FROM lineitem)
SELECT l_suppkey, min(v) >= 0 AS positive, max(v) <= 100 AS bounded, round(avg(down) FILTER (NOT first), 6) AS descending, coalesce(min(v) >= 0 AND max(v) <= 100 AND round(avg(down) FILTER (NOT first), 6) > 0.7, false) AS is_score FROM d GROUP BY 1""")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 215."""
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount").alias("o"), (F.col("l_discount") * 100).alias("v"))
    return arrays.score_like(v, "l_suppkey", "o", "v")


@query("""WITH s AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) SELECT o_custkey, coalesce(count(*) >= 5 AND avg(step) BETWEEN 0.5 AND 2 AND avg(CASE WHEN step IS NULL THEN NULL WHEN step BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0.0 END) > 0.8, false) AS sequential FROM s GROUP BY 1""")
def sequential_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 216."""
    return arrays.sequential(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").withColumn("sequential", F.coalesce("sequential", F.lit(False)))


@query("""WITH c AS (SELECT p_partkey, length(p_name) AS n, unnest(string_split(p_name, '')) AS ch FROM part), f AS (SELECT p_partkey, n, ch, count(*) / n AS p FROM c WHERE ch <> '' GROUP BY p_partkey, n, ch)
SELECT p_partkey, round(CASE WHEN any_value(n) <= 1 THEN 0 ELSE -sum(p * log2(p)) / log2(any_value(n)) END, 6) AS entropy FROM f GROUP BY 1""")
def name_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 285."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(arrays.entropy(F.col("p_name")), 6).alias("entropy"))


# lines ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOC_LINES}, g AS (SELECT doc_id, n, line, CASE WHEN line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY n) OR n = 0 THEN 1 ELSE 0 END AS c FROM doc_lines),
r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM g), k AS (SELECT doc_id, run, min(n) AS n, min(line) AS line, count(*) AS times FROM r GROUP BY ALL),
s AS (SELECT doc_id, n, CASE WHEN times >= 2 AND (times - 1) * (length(line) + 1) > length(' …x' || times) THEN line || ' …x' || times ELSE array_to_string(list_transform(range(times), lambda i: line), chr(10)) END AS shown FROM k)
SELECT doc_id, string_agg(shown, chr(10) ORDER BY n) AS text FROM s GROUP BY 1""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 240."""
    return lines.collapse_runs(doc_lines(spark, sf_dir), "doc_id")


@query(f"""WITH {DOC_LINES}, m AS (SELECT source, doc_id * 10000 + n AS n, source || '/' || doc_id || '.txt' AS path, n + 1 AS no, line FROM doc_lines JOIN documents USING (doc_id) WHERE line LIKE '%License%'),
f AS (SELECT *, path IS DISTINCT FROM lag(path) OVER (PARTITION BY source ORDER BY n) AS fresh FROM m) SELECT source, string_agg(CASE WHEN fresh THEN path || chr(10) ELSE '' END || no || ':' || line, chr(10) ORDER BY n) AS text FROM f GROUP BY 1""")
def search_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 21, 242."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    hits = doc_lines(spark, sf_dir).where(F.col("line").contains("License")).join(d, "doc_id")
    rows = hits.select("source", (F.col("doc_id") * 10000 + F.col("n")).alias("n"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt:"), (F.col("n") + 1).cast("string"), F.lit(":"), "line").alias("line"))
    return lines.heading_fold(lines.grep_rows(rows), "source")


@query(f"""WITH {LOG_LINES}, t AS (SELECT line, regexp_extract(regexp_replace(line, '[0-9]+', '<n>', 'g'), '^[^:=]*') AS template FROM log_lines) SELECT template, count(*) AS lines, min(line) AS example FROM t GROUP BY 1 HAVING count(*) >= 3""")
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 250, 254."""
    return lines.templates(log_lines(spark, sf_dir))


@query(f"""WITH {LOG_LINES} SELECT log_id, CASE WHEN line LIKE '% ERROR %' THEN 'error' WHEN line LIKE '% WARN %' THEN 'warn' ELSE 'info' END AS level, count(*) AS n FROM log_lines GROUP BY ALL""")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 22."""
    return log_lines(spark, sf_dir).groupBy("log_id", text.log_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOC_LINES} SELECT doc_id, line, min(n) AS first, list(n ORDER BY n) AS at FROM doc_lines GROUP BY ALL""")
def line_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 251."""
    return lines.dedupe(doc_lines(spark, sf_dir), "doc_id")


_CONTENTS = LOG_LINES + r""", line AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
texts AS (
  SELECT 'log' AS origin, string_agg(line, chr(10) ORDER BY n) AS t FROM log_lines GROUP BY log_id
  UNION ALL SELECT 'page', html FROM pages UNION ALL SELECT 'document', text FROM documents
  UNION ALL SELECT 'array', '[' || string_agg('{"id": ' || o_orderkey || '}', ', ' ORDER BY o_orderkey) || ']' FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'table', string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment, chr(10) ORDER BY c_custkey) FROM customer GROUP BY c_nationkey
  UNION ALL SELECT 'search', string_agg('src/' || doc_id || '.txt:' || n || ':' || line, chr(10) ORDER BY n) FROM line GROUP BY doc_id
  UNION ALL SELECT 'diff', 'diff --git a/x b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || string_agg('+' || line, chr(10) ORDER BY n) FROM line GROUP BY doc_id
), parts AS (SELECT origin, t, string_split(t, chr(10)) AS e, substr(t, 1, 3000) AS head FROM texts),
near AS (SELECT *, list_filter(e[1:100], lambda x: trim(x) <> '') AS s100, list_filter(e[1:200], lambda x: trim(x) <> '') AS s200 FROM parts),
found AS (
  SELECT origin, t, CASE WHEN regexp_matches(head, '(?i)<!doctype html') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(head, '(?i)<html[\s>]') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(head, '(?i)<head[\s>]') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(head, '(?i)<body[\s>]') THEN 0.1 ELSE 0 END AS html,
    len(list_filter(e[1:500], lambda x: regexp_matches(x, '^(diff --git |diff --combined |diff --cc |--- a/|\+\+\+ b/|@@ -\d+)'))) AS headers, len(list_filter(e[1:500], lambda x: regexp_matches(x, '^[+-][^+-]'))) AS changes,
    len(list_filter(s100, lambda x: regexp_matches(x, '^[^\s:]+:\d+:'))) / greatest(1, len(s100)) AS hits,
    len(list_filter(s200, lambda x: regexp_matches(x, '^\s*(\[?\d{4}-\d{2}-\d{2}|\[?(INFO|WARN|WARNING|ERROR|DEBUG|FATAL|CRITICAL)\b)'))) / greatest(1, len(s200)) AS logged,
    len(list_filter(s200, lambda x: regexp_matches(x, '\b(ERROR|FATAL|CRITICAL)\b'))) AS errors, list_transform(s200, lambda x: len(string_split(x, ','))) AS commas FROM near
)"""


@query(f"""WITH {_CONTENTS} SELECT origin, CASE WHEN regexp_matches(t, '^\\s*[\\[{{]') AND json_valid(t) THEN 'json' WHEN headers > 0 AND least(1.0, 0.5 + 0.2 * headers + 0.05 * changes) >= 0.7 THEN 'diff' WHEN html >= 0.7 THEN 'html'
WHEN hits >= 0.3 AND 0.4 + 0.6 * hits >= 0.6 THEN 'search' WHEN logged >= 0.1 AND least(1.0, 0.3 + 0.5 * logged + 0.05 * errors) >= 0.5 THEN 'log' WHEN len(commas) >= 3 AND commas[1] >= 3 AND len(list_distinct(commas)) = 1 THEN 'tabular' ELSE 'text' END AS kind, count(*) AS n FROM found GROUP BY ALL""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 40-47: of all logs, pages and documents, of orders as arrays, customers as tables, and of documents' lines as searches and diffs."""
    t = lambda name: table(spark, sf_dir, name)
    text_of = lambda df, key, order, line, origin: lines.joined(df, key, order, line, "text").select(F.lit(origin).alias("origin"), "text")
    own = doc_lines(spark, sf_dir)
    array = text_of(t("orders"), "o_custkey", "o_orderkey", F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit("}")), "array")
    parts = [
        text_of(log_lines(spark, sf_dir), "log_id", "n", F.col("line"), "log"), t("pages").select(F.lit("page"), "html"), t("documents").select(F.lit("document"), "text"),
        array.select("origin", F.concat(F.lit("["), F.replace("text", F.lit("\n"), F.lit(", ")), F.lit("]"))),
        text_of(t("customer"), "c_nationkey", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), "table"),
        text_of(own, "doc_id", "n", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt:"), F.col("n").cast("string"), F.lit(":"), "line"), "search"),
        text_of(own, "doc_id", "n", F.concat(F.lit("+"), "line"), "diff").select("origin", F.concat(F.lit("diff --git a/x b/x\n@@ -1 +1 @@\n"), "text")),
    ]
    every = reduce(DataFrame.union, parts)
    return every.groupBy("origin", lines.content_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS emails, CAST(len(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS BIGINT) AS ips,
greatest(0, 100 - 10 * CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT)) AS score FROM documents""")
def volatile_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 297, 298."""
    v = text.volatile_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", v["emails"].alias("emails"), v["ips"].alias("ips"), text.alignment_score(v["emails"]).alias("score"))


@query("""SELECT page_id, length(html) AS before, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS after FROM pages""".replace("length(html)", "CAST(length(html) AS BIGINT)").replace("length(regexp", "CAST(length(regexp").replace(" AS after", " AS BIGINT) AS after"))
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 18: markup and text of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("before"), F.length(F.regexp_replace("html", text.HTML_TAG, "")).cast("long").alias("after"))


# memories and graphs --------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_until, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id, o_custkey, valid_from, valid_until, superseded_by FROM v""")
def memory_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 340."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return memory.superseded(o, "o_custkey", "o_orderdate", "id").drop("o_orderdate")


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until, o_totalprice / 500000 AS importance FROM orders)
SELECT id, user_id FROM v WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-01-01') AND importance >= 0.3""")
def memories_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 35."""
    import datetime

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "o_orderdate", (F.col("o_totalprice") / 500000).alias("importance"))
    v = memory.superseded(o, "user_id", "o_orderdate", "id")
    return memory.scoped(v, at=datetime.date(1996, 1, 1), least=0.3).select("id", "user_id")


@query("""WITH v AS (SELECT o_custkey AS user_id, o_orderkey AS id, round(o_totalprice / 500000 * exp(-0.01 * date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')) + least(0.3, 0.05 * (o_orderkey % 9)), 6) AS value FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS rank FROM v WHERE value >= 0.05) SELECT user_id, id, value, rank FROM r WHERE rank <= 3""")
def memory_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 166, 189."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("importance"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 9).alias("accesses"))
    return memory.decayed_rank(m, F.to_date(F.lit("1999-01-01")), 3).select("user_id", "id", "value", "rank")


@query("""WITH s AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS s FROM documents) SELECT source, doc_id FROM s WHERE s <= 60000""")
def cache_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 190, 191."""
    return memory.within_bytes(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("doc_id")], "n_chars", 60000).select("source", "doc_id")


@query(f"""WITH {EDGES}, b AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), h1 AS (SELECT DISTINCT b.b AS id FROM b WHERE a = 'r0'), h2 AS (SELECT DISTINCT b.b AS id FROM b JOIN h1 ON b.a = h1.id)
SELECT 'r0' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 'r0' AND id NOT IN (SELECT id FROM h1)""")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 334."""
    return memory.k_hop(edges(spark, sf_dir), spark.createDataFrame([("r0",)], "id string"), 2)


@query(f"""WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1""")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 337."""
    return memory.degrees(edges(spark, sf_dir))


@query("""SELECT c_custkey AS custkey, 'export' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'import' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def sync_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 94."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return memory.difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), orders, "custkey")


@query(f"""WITH {REQUESTS} SELECT mode AS provider, model, max(CASE WHEN k % 2 = 1 THEN value END) AS at_least, min(CASE WHEN k % 2 = 0 THEN value END) AS below FROM requests GROUP BY ALL""")
def learned_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 360."""
    return memory.learned_ttl(requests(spark, sf_dir).select(F.col("mode").alias("provider"), "model", (F.col("k") % 2 == 1).alias("hit"), F.col("value").alias("idle")))
