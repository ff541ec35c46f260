"""Queries of JSON arrays as tables, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators import tables
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import table


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as an array of objects: an inner object, fields by status, a null now and then."""
    o = table(spark, sf_dir, "orders")
    named = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("part")
    day = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("string")
    json = F.concat(
        F.lit('{"total": {"priority": "'), "o_orderpriority", F.lit('", "cents": '), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit('}, "id": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), "o_orderstatus", F.lit('", "'),
        named, F.lit('": true, "'), named, F.lit('_on": '), day, F.when(F.col("o_orderkey") % 4 == 0, ', "note": null}').otherwise("}"),
    )
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("key"), pos.cast("long").alias("pos"), F.parse_json(json).alias("item"))


_CELLS = """o AS (
  SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS priority,
         CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'part' END AS named, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders
), cell AS (
  SELECT key, pos, status, 'id' AS col, 'int' AS type, CAST(id AS VARCHAR) AS json FROM o
  UNION ALL SELECT key, pos, status, 'status', 'string', '"' || status || '"' FROM o
  UNION ALL SELECT key, pos, status, 'total.cents', 'int', CAST(cents AS VARCHAR) FROM o
  UNION ALL SELECT key, pos, status, 'total.priority', 'string', '"' || priority || '"' FROM o
  UNION ALL SELECT key, pos, status, named, 'bool', 'true' FROM o
  UNION ALL SELECT key, pos, status, named || '_on', 'int', CAST(day AS VARCHAR) FROM o
  UNION ALL SELECT key, pos, status, 'note', 'null', 'null' FROM o WHERE id % 4 = 0
), size AS (SELECT key, count(*) AS n, count(DISTINCT status) AS kinds FROM o GROUP BY 1),
field AS (SELECT key, split_part(col, '.', 1) AS f, count(DISTINCT pos) AS n FROM cell GROUP BY ALL),
told AS (SELECT size.key, avg(CASE WHEN field.n = size.n THEN 1.0 ELSE 0 END) < 0.6 AND any_value(kinds) BETWEEN 2 AND 8 AND any_value(kinds) <= 0.7 * any_value(size.n) AS split FROM field JOIN size USING (key) GROUP BY 1),
placed AS (SELECT cell.*, split, CASE WHEN split THEN '"' || status || '"' ELSE '' END AS bucket FROM cell JOIN told USING (key)),
sized AS (SELECT key, bucket, count(DISTINCT pos) AS rows_ FROM placed GROUP BY ALL),
cols AS (SELECT p.key, p.bucket, col, any_value(type) AS type, count(*) AS n, count(*) < any_value(rows_) OR any_value(type) = 'null' AS optional FROM placed p JOIN sized s ON s.key = p.key AND s.bucket = p.bucket GROUP BY p.key, p.bucket, col),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key, bucket ORDER BY n DESC, col) - 1 AS c FROM cols),
head AS (SELECT key, bucket, string_agg(col || CASE WHEN optional THEN '?' ELSE '' END || ':' || type, ',' ORDER BY c) AS h, count(*) AS of_ FROM numbered GROUP BY ALL),
rows_ AS (
  SELECT p.key, p.bucket, p.pos, any_value(p.split) AS split, string_agg(json, ',' ORDER BY c) AS cells, list(c) AS has
  FROM placed p JOIN numbered n ON n.key = p.key AND n.bucket = p.bucket AND n.col = p.col GROUP BY p.key, p.bucket, p.pos
), lines AS (
  SELECT r.key, r.bucket, pos, split, CASE WHEN split THEN '@' || pos || ' ' ELSE '' END
         || CASE WHEN len(has) < of_ THEN '!' || array_to_string(list_filter(range(of_), lambda i: NOT list_contains(has, i)), '.') || ' ' ELSE '' END || cells AS line
  FROM rows_ r JOIN head h ON h.key = r.key AND h.bucket = r.bucket
), one AS (
  SELECT l.key, l.bucket, '[' || count(*) || ']{' || any_value(h) || '}' || CASE WHEN any_value(split) THEN 'status=' || l.bucket ELSE '' END || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS t
  FROM lines l JOIN head h ON h.key = l.key AND h.bucket = l.bucket GROUP BY l.key, l.bucket
)"""


@query(f"""WITH {_CELLS} SELECT key, string_agg(t, chr(10) ORDER BY bucket) AS text FROM one GROUP BY 1""")
def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 224, 225, 226, 230."""
    return tables.csv_schema(tables.tables(order_items(spark, sf_dir)))


@query("""SELECT o_custkey AS key, count(*) AS rows, true AS same FROM orders GROUP BY 1""")
def restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 224: whether every array comes back from its text."""
    items = order_items(spark, sf_dir)
    back = tables.restored(tables.csv_schema(tables.tables(items))).select("key", "pos", F.to_json("item").alias("back"))
    # items and what came back are put together by grouping: a join would deal both out anew by key and place
    none = F.lit(None).cast("string")
    each = items.select("key", "pos", F.to_json("item").alias("json"), none.alias("back")).union(back.select("key", "pos", none, "back"))
    both = each.groupBy("key", "pos").agg(F.max("json").alias("json"), F.max("back").alias("back"), F.count("*").alias("n"))
    return both.groupBy("key").agg(F.count("*").alias("rows"), F.bool_and(F.col("json").eqNullSafe(F.col("back")) & (F.col("n") == 2)).alias("same"))


@query("""WITH o AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS id, o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'part' END AS k,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS p FROM orders),
c AS (SELECT key, pos, unnest([k, k || '_on', 'id', 'note', 'status', 'total.cents', 'total.priority']) AS f, unnest(['true', CAST(day AS VARCHAR), CAST(id AS VARCHAR), CASE WHEN id % 4 = 0 THEN 'null' END, s, CAST(cents AS VARCHAR), p]) AS v FROM o),
r AS (SELECT key, pos, string_agg(f || ': ' || v, chr(10) ORDER BY f) AS t FROM c WHERE v IS NOT NULL GROUP BY ALL)
SELECT key, count(*) || ' records' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM r GROUP BY 1""")
def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 232."""
    return tables.markdown_records(order_items(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS l FROM documents)
SELECT doc_id AS id, '$.lines' AS at, count(*) AS items, CAST(sum(n) AS BIGINT) AS total FROM (SELECT doc_id, unnest(l) AS n FROM d) GROUP BY 1
UNION ALL SELECT doc_id, '$.deep.pairs[' || p || ']', 2, p + n FROM (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS n FROM d)
UNION ALL SELECT doc_id, '$.deep.pairs', len(l), NULL FROM d""")
def walked_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 228: the arrays inside documents of which a part is a string of JSON."""
    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("string"))
    lines = F.concat(F.lit("["), F.array_join(lengths, ","), F.lit("]"))
    pairs = F.concat(F.lit("["), F.array_join(F.transform(lengths, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit(","), x, F.lit("]"))), ","), F.lit("]"))
    json = F.concat(F.lit('{"lines": '), lines, F.lit(', "deep": "{\\"pairs\\": '), pairs, F.lit('}"}'))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.parse_json(json).alias("value"))
    return tables.inner_arrays(docs).groupBy("id", "at").agg(F.count("*").alias("items"), F.sum(F.try_variant_get("item", "$", "long")).alias("total"))
