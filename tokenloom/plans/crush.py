"""Registered queries of the array rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.operators import crush
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import table

#: Orders by customer as arrays of three fields.
_ARRAYS = """v AS (SELECT o_custkey AS key, o_orderkey AS i, unnest(['o_orderkey', 'o_totalprice', 'o_orderstatus', 'o_orderpriority']) AS field, unnest(['numeric', 'numeric', 'string', 'string']) AS kind,
  unnest([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), o_orderstatus, o_orderpriority]) AS value, unnest([CAST(o_orderkey AS DOUBLE), o_totalprice, NULL, NULL]) AS number FROM orders),
s AS (SELECT key, field, kind, count(*) AS n, count(DISTINCT value) / count(*) AS u, coalesce(var_samp(number), 0) AS var, avg(number) AS mean, (max(number) - min(number)) / greatest(count(*) - 1, 1) AS step FROM v GROUP BY ALL),
c AS (SELECT *, CASE WHEN u < 0.9 THEN 0.0 WHEN kind = 'numeric' AND n >= 5 AND step BETWEEN 0.5 AND 2 THEN 0.9 WHEN u > 0.98 THEN 0.7 ELSE 0.0 END AS idc FROM s),
ids AS (SELECT key, max((idc, u, field)) AS t, max(idc) AS idc, arg_max(u, (idc, u, field)) AS idu, arg_max(field, (idc, u, field)) AS idf FROM c GROUP BY 1),
content AS (SELECT c.key, coalesce(avg(u) FILTER (kind = 'string'), 0) AS strings, coalesce(avg(u) FILTER (kind = 'numeric'), 0) AS numbers FROM c JOIN ids USING (key) WHERE field <> idf OR ids.idc < 0.7 GROUP BY 1),
marks AS (SELECT v.key, i, coalesce(bool_or(var > 0 AND abs(number - mean) > 2 * sqrt(var)), false) AS far FROM v JOIN s USING (key, field) GROUP BY ALL),
d AS (SELECT m.key, m.n, CASE WHEN idc >= 0.7 AND greatest(strings, numbers) < 0.1 THEN 'repeats_with_ids' WHEN most < 0.3 THEN 'repeats' WHEN idc >= 0.7 AND most > 0.8 AND NOT signal THEN 'entities' WHEN most > 0.8 AND signal THEN 'entities_with_signal' WHEN NOT signal THEN 'mixed' ELSE 'mixed_with_signal' END AS reason
  FROM (SELECT m.key, m.n, signal, ids.idc, coalesce(strings, 0) AS strings, coalesce(numbers, 0) AS numbers, greatest(coalesce(strings, 0), CASE WHEN ids.idc >= 0.7 THEN idu ELSE 0 END) AS most
    FROM (SELECT key, count(*) AS n, bool_or(far) AS signal FROM marks GROUP BY 1) m JOIN ids USING (key) LEFT JOIN content USING (key)) m)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    values = crush.long_items(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    stats = crush.profiles(values)
    marks = crush.signals(values, stats)
    return values, marks, crush.decide(stats, marks)


@query(f"WITH {_ARRAYS} SELECT key, n, reason, reason NOT IN ('entities', 'mixed') AS crushable FROM d")
def array_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 208, 211, 214."""
    return _parts(spark, sf_dir)[2]


@query(f"""WITH {_ARRAYS}, r AS (SELECT m.key, m.i, m.far, d.n, d.reason, row_number() OVER (PARTITION BY m.key ORDER BY m.i) AS first, row_number() OVER (PARTITION BY m.key ORDER BY m.i DESC) AS back FROM marks m JOIN d USING (key)),
w AS (SELECT *, CASE WHEN reason IN ('entities', 'mixed') OR n <= 6 THEN 'whole' WHEN far THEN 'far' WHEN first <= 3 OR back <= 2 THEN 'edge' ELSE 'rest' END AS why FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY why = 'rest', first) AS rank FROM w) SELECT key, i, why FROM k WHERE why <> 'rest' OR rank <= 6""")
def array_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 174, 179, 193, 203."""
    values, marks, decisions = _parts(spark, sf_dir)
    return crush.kept(values, marks, decisions, 6)


@query()
def array_offloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 176, 203, 229: with the neighbours of changes in price kept too."""
    values, marks, decisions = _parts(spark, sf_dir)
    return crush.offloaded(decisions, crush.kept(values, marks, decisions, 6, "o_totalprice"))
