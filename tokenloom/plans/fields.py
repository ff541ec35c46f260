"""Registered queries of the rules on fields of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import fields
from tokenloom.operators.sequences import change_points
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import table

#: Orders by customer: dates only for every other customer, a fraction for every third, a note on few orders.
_ITEMS = """v AS (SELECT o_custkey AS key, o_orderkey AS i, 'id' AS field, 'numeric' AS kind, CAST(o_orderkey AS VARCHAR) AS value, CAST(o_orderkey AS DOUBLE) AS number FROM orders
UNION ALL SELECT o_custkey, o_orderkey, 'state', 'string', o_orderstatus, NULL FROM orders
UNION ALL SELECT o_custkey, o_orderkey, 'message', 'string', o_orderpriority, NULL FROM orders
UNION ALL SELECT o_custkey, o_orderkey, 'date', 'string', strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT o_custkey, o_orderkey, 'score', 'numeric', CAST(o_orderkey % 8 / 8 AS VARCHAR), o_orderkey % 8 / 8 FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_custkey, o_orderkey, 'note', 'string', 'n' || o_orderkey, NULL FROM orders WHERE o_orderkey % 9 = 0),
items AS (SELECT key, count(DISTINCT i) AS items FROM v GROUP BY 1),
f AS (SELECT key, field, kind, any_value(items) AS items, count(*) AS n, count(DISTINCT value) AS kinds, avg(length(value)) AS length, coalesce(var_samp(number), 0) AS variance, count(*) >= 0.8 * any_value(items) AS common, count(*) < 0.2 * any_value(items) AS rare FROM v JOIN items USING (key) GROUP BY ALL)"""
_PATTERNS = r"""sc AS (SELECT key, field, number, i, lag(number) OVER (PARTITION BY key, field ORDER BY i) >= number AS down, row_number() OVER (PARTITION BY key, field ORDER BY i) AS p, number - lag(number) OVER (PARTITION BY key, field ORDER BY number) AS step FROM v WHERE kind = 'numeric'),
sg AS (SELECT key, field, count(*) AS n, min(number) AS low, max(number) AS high, avg(down::INT) AS down, avg((number <> floor(number))::INT) FILTER (p <= 20) AS broken, avg(step) AS step, avg((step BETWEEN 0.5 AND 2)::INT) AS even FROM sc GROUP BY ALL),
cf AS (SELECT key, field, CASE WHEN low < -1 OR high > 100 OR (low < 0 AND high > 1) OR coalesce(n >= 5 AND step BETWEEN 0.5 AND 2 AND even > 0.8, false) THEN 0.0
  ELSE round(least(0.95, CAST(CASE WHEN low >= 0 AND high <= 1 THEN 0.4 WHEN low >= 0 AND high <= 10 THEN 0.3 WHEN low >= 0 THEN 0.25 ELSE 0.35 END AS DOUBLE) + CASE WHEN n >= 5 AND down > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN broken > 0.3 THEN 0.1 ELSE 0 END), 2) END AS confidence FROM sg),
te AS (SELECT key, true AS temporal FROM v WHERE field = 'date' GROUP BY 1),
si AS (SELECT key, bool_or(kind = 'numeric' AND variance > 0) AS varies, bool_or(kind = 'string' AND kinds / n > 0.5 AND length > 20) AS messages, bool_or(kind = 'string' AND kinds / n < 0.1 AND kinds BETWEEN 2 AND 10) AS levels FROM f GROUP BY 1),
pt AS (SELECT key, CASE WHEN coalesce(temporal, false) AND varies THEN 'time_series' WHEN messages AND levels THEN 'logs' WHEN top >= 0.5 THEN 'search_results' ELSE 'generic' END AS pattern
  FROM si LEFT JOIN te USING (key) LEFT JOIN (SELECT key, max(confidence) AS top FROM cf GROUP BY 1) USING (key))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    id_, cust = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    one = lambda field, kind, value, number, when: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), number.cast("double").alias("number")))
    score = id_ % 8 / 8
    each = [
        one("id", "numeric", id_, id_, F.lit(True)), one("state", "string", F.col("o_orderstatus"), none, F.lit(True)), one("message", "string", F.col("o_orderpriority"), none, F.lit(True)),
        one("date", "string", F.date_format("o_orderdate", "yyyy-MM-dd"), none, cust % 2 == 0), one("score", "numeric", score, score, cust % 3 == 0), one("note", "string", F.concat(F.lit("n"), id_), none, id_ % 9 == 0),
    ]
    return o.select(cust.alias("key"), id_.alias("i"), F.explode(F.array_compact(F.array(*each))).alias("p")).select("key", "i", "p.*")


@query(f"""WITH {_ITEMS}, c AS (SELECT v.key, v.field, value, count(*) AS n FROM v JOIN f USING (key, field) WHERE common GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS run, row_number() OVER w AS place, count(*) OVER (PARTITION BY key, field) AS kinds, sum(n) OVER (PARTITION BY key, field) AS total FROM c WINDOW w AS (PARTITION BY key, field ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING)),
m AS (SELECT key, field, min(place) AS needed FROM r WHERE run >= ceil(total * 0.8) AND kinds BETWEEN 2 AND 50 GROUP BY ALL), odd AS (SELECT key, field, value FROM r JOIN m USING (key, field) WHERE needed <= 5 AND place > needed)
SELECT DISTINCT key, i FROM v WHERE key IN (SELECT key FROM items WHERE items >= 5) AND ((key, field) IN (SELECT (key, field) FROM f WHERE rare) OR (key, field, value) IN (SELECT (key, field, value) FROM odd))""")
def structural_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 218, 219."""
    return fields.structural_outliers(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, c AS (SELECT key, field, value, count(*) AS same FROM v GROUP BY ALL),
x AS (SELECT v.key, v.i, any_value(f.items) AS items, avg(1 - same / f.items) AS val, sum(length(v.field) + length(v.value) + CASE v.kind WHEN 'string' THEN 2 ELSE 0 END + 4) + 1 AS len, count(*) FILTER (rare) AS r, count(*) FILTER (common) AS c FROM v JOIN f USING (key, field) JOIN c USING (key, field, value) GROUP BY ALL),
a AS (SELECT key, min(len) AS low, max(len) AS high FROM x GROUP BY 1), k AS (SELECT key, count(*) FILTER (rare) AS rs, count(*) FILTER (common) AS cs FROM f GROUP BY 1)
SELECT key, i, round(CASE WHEN items < 2 THEN 0.5e0 ELSE 0.4e0 * val + 0.3e0 * CASE WHEN low = high THEN 0.5 ELSE (len - low) / (high - low) END + 0.3e0 * least(1, 0.5e0 * CASE WHEN rs > 0 THEN r / rs ELSE 0 END + 0.5e0 * CASE WHEN cs > 0 THEN (cs - c) / cs ELSE 0 END) END, 6) AS score FROM x JOIN a USING (key) JOIN k USING (key)""")
def information_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 182."""
    return fields.information(_items(spark, sf_dir))


@query(f"WITH {_ITEMS}, {_PATTERNS} SELECT key, field, CAST(confidence AS DOUBLE) AS confidence FROM cf")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 215."""
    return fields.scores(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, {_PATTERNS}, dc AS (SELECT c_custkey AS key, c_acctbal > 0 AS crushable FROM customer), ch AS (SELECT o_custkey AS key FROM orders GROUP BY 1 HAVING max(o_totalprice) > 5 * min(o_totalprice)),
st AS (SELECT pt.key, pattern, CASE WHEN items < 5 THEN 'none' WHEN NOT crushable THEN 'skip' WHEN pattern = 'time_series' AND ch.key IS NOT NULL THEN 'time_series' WHEN pattern = 'logs' AND ratio < 0.5 THEN 'cluster_sample' WHEN pattern = 'search_results' THEN 'top_n' ELSE 'smart_sample' END AS strategy, constant
  FROM pt JOIN items USING (key) LEFT JOIN dc USING (key) LEFT JOIN ch USING (key) JOIN (SELECT key, avg((kinds = 1)::INT) AS constant, max(kinds / n) FILTER (field = 'message') AS ratio FROM f GROUP BY 1) USING (key))
SELECT key, pattern, strategy, round(CASE strategy WHEN 'none' THEN 0e0 ELSE least(0.95e0, CASE strategy WHEN 'time_series' THEN 0.7e0 WHEN 'cluster_sample' THEN 0.8e0 WHEN 'top_n' THEN 0.6e0 WHEN 'smart_sample' THEN 0.5e0 ELSE 0.3e0 END + constant * 0.2e0) END, 6) AS reduction FROM st""")
def array_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 209, 210, 212, 213: accounts in debt aren't crushable; prices that rise fivefold stand for change points."""
    decisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("crushable"))
    changing = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg((F.max("o_totalprice") > 5 * F.min("o_totalprice")).alias("c")).where("c")
    return fields.strategies(_items(spark, sf_dir), decisions, changing)


_PRICES = "nb AS (SELECT o_custkey AS key, o_orderkey AS i, o_totalprice AS number FROM orders)"


@query(f"""WITH {_PRICES}, a AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY key) AS n, avg(number) OVER (PARTITION BY key) AS mean, coalesce(stddev_samp(number) OVER (PARTITION BY key), 0) AS sd, avg(number) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, avg(number) OVER (w ROWS BETWEEN 0 FOLLOWING AND 4 FOLLOWING) AS r FROM nb WINDOW w AS (PARTITION BY key ORDER BY i)),
y AS (SELECT *, CASE WHEN n <= 8 THEN 'whole' WHEN sd > 0 AND abs(number - mean) > 2 * sd THEN 'far' WHEN n > 10 AND sd > 0 AND p >= 5 AND p < n - 5 AND abs(r - l) > 2 * sd THEN 'turn' WHEN p < 3 OR p >= n - 2 THEN 'edge' END AS why FROM a),
z AS (SELECT *, count(why) OVER (PARTITION BY key) AS kept, count(*) FILTER (why = 'far') OVER (PARTITION BY key) AS outliers FROM y),
q AS (SELECT *, why IS NULL AND kept < 10 AND p % greatest(1, (n - 1) // (10 - kept + 1)) = 0 AS spread FROM z), t AS (SELECT *, count(*) FILTER (spread) OVER (PARTITION BY key ORDER BY i) AS rank FROM q)
SELECT key, i, number, coalesce(why, 'spread') AS why FROM t WHERE why IS NOT NULL OR (spread AND rank <= 10 + outliers - kept)""")
def kept_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 205: ten prices of each customer."""
    return fields.kept_numbers(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("number")), 10)


@query(f"""WITH {_PRICES} SELECT key, count(*) AS n, min(number) AS low, max(number) AS high, round(avg(number), 6) AS mean, round(quantile_cont(number, 0.5), 6) AS median, round(coalesce(stddev_samp(number), 0), 6) AS sd, round(quantile_cont(number, 0.25), 6) AS p25, round(quantile_cont(number, 0.75), 6) AS p75 FROM nb GROUP BY 1""")
def number_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 205."""
    return fields.number_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("number")))


@query("""WITH e AS (SELECT event_type, 'k' AS field, json_extract_string(props, '$.k') AS s FROM events), x AS (SELECT *, s::DOUBLE AS x FROM e),
g AS (SELECT event_type, field, count(*) AS n, bool_or(x < 0) AS negative, bool_and(x = floor(x)) AS whole, var_pop(x) AS v, avg(x) AS m, min(x) AS low, max(x) AS high FROM x GROUP BY ALL)
SELECT event_type, field, n, 'numeric' AS type, CAST(NULL AS DOUBLE) AS mean_length, CAST(NULL AS DOUBLE) AS uniqueness, CAST(NULL AS BOOLEAN) AS id_like, negative, whole, CASE WHEN n > 1 THEN CASE WHEN v = 0 THEN 'zero' WHEN v < 10 THEN 'low' WHEN v < 1000 THEN 'medium' ELSE 'high' END END AS spread, v > 0 AND greatest(high - m, m - low) > 2 * sqrt(v) AS outliers FROM g""")
def field_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 126."""
    return fields.distributions(table(spark, sf_dir, "events"), "event_type", "props")
