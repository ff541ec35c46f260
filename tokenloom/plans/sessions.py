"""Queries over sessions of texts, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import sessions
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import table


def numbered_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads of a session, a session a source: lines numbered from a place of the document's own."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lpad((i + 1 + F.col("doc_id") % 7 * 10).cast("string"), 6, " "), F.lit("\t"), x))
    return sessions.blocks(table(spark, sf_dir, "documents").select("source", "doc_id", F.array_join(lines, "\n").alias("text")), "source", "doc_id", "text")


_READS = r"""d AS (
  SELECT source AS session, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS block, doc_id AS turn, doc_id % 7 * 10 AS base, string_split(text, chr(10)) AS raw FROM documents
), line AS (
  SELECT session, block, unnest(range(len(raw))) AS n, unnest(raw) AS body, base FROM d
), numbered AS (SELECT session, block, n, n + 1 + base AS num, body, lpad(CAST(n + 1 + base AS VARCHAR), 6, ' ') || chr(9) || body AS line FROM line),
win AS (
  SELECT session, block, n, num, body || chr(10) || lead(body) OVER w || chr(10) || lead(body, 2) OVER w AS h FROM numbered WINDOW w AS (PARTITION BY session, block ORDER BY n)
), kind AS (SELECT session, block, h, list(n ORDER BY n) AS ns, list(num ORDER BY n) AS nums FROM win WHERE h IS NOT NULL GROUP BY ALL),
src AS (SELECT session, h, min(block) AS b0, arg_min(ns, block) AS sn, arg_min(nums, block) AS snum FROM kind GROUP BY ALL),
pair AS (
  SELECT session, block, b0, unnest(ns) AS n, unnest(nums) AS num, unnest(list_transform(range(1, len(ns) + 1), lambda i: sn[least(i, len(sn))])) AS m, unnest(list_transform(range(1, len(ns) + 1), lambda i: snum[least(i, len(sn))])) AS mnum
  FROM kind JOIN src USING (session, h) WHERE block > b0
), along AS (SELECT *, n - m AS diag, num - mnum AS shift, coalesce(n - lag(n) OVER (PARTITION BY session, block, b0, n - m, num - mnum ORDER BY n) > 3, true) AS begins FROM pair),
island AS (
  SELECT session, block, b0, diag, shift, min(n) AS low, max(n) + 3 AS high
  FROM (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY session, block, b0, diag, shift ORDER BY n) AS i FROM along) GROUP BY session, block, b0, diag, shift, i
), best AS (
  SELECT session, block, n, max(o) AS o FROM (SELECT session, block, unnest(range(low, high)) AS n, {'size': high - low, 'early': -low, 'old': -b0, 'diag': diag, 'shift': shift} AS o FROM island) GROUP BY ALL
), span AS (SELECT session, block, o, min(n) AS low, max(n) + 1 AS high FROM best GROUP BY ALL HAVING max(n) + 1 - min(n) >= 3),
marked AS (
  SELECT s.*, '[[' || (high - low) || ' lines of block ' || (-o.old) || ' from ' || (low - o.diag + 1) || ', numbers ' || CASE WHEN o.shift < 0 THEN '' ELSE '+' END || o.shift || ']]' AS mark,
         (SELECT sum(length(line) + 1) - 1 FROM numbered l WHERE l.session = s.session AND l.block = s.block AND l.n >= s.low AND l.n < s.high) AS chars FROM span s
), folded AS (SELECT * FROM marked WHERE chars >= 40 AND length(mark) < chars),
shown AS (SELECT l.session, l.block, l.n, f.low, f.high, f.chars, f.mark, l.line FROM numbered l LEFT JOIN folded f ON f.session = l.session AND f.block = l.block AND l.n >= f.low AND l.n < f.high WHERE f.low IS NULL OR f.low = l.n)"""


@query(f"""WITH {_READS} SELECT session, block, count(low) AS spans, CAST(coalesce(sum(high - low), 0) AS BIGINT) AS lines, CAST(coalesce(sum(chars - length(mark)), 0) AS BIGINT) AS chars, sha256(string_agg(coalesce(mark, line), chr(10) ORDER BY n)) AS folded FROM shown GROUP BY ALL""")
def folded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 248: every read with the spans that its session has shown before folded."""
    out = sessions.fold_repeats(numbered_reads(spark, sf_dir))
    return out.select("session", "block", "spans", "lines", "chars", F.sha2("text", 256).alias("folded"))


@query("""SELECT source AS session, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS block, true AS same FROM documents""")
def unfolded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 248: whether what was folded comes back whole."""
    reads = numbered_reads(spark, sf_dir)
    back = sessions.unfold_repeats(sessions.fold_repeats(reads)).withColumnRenamed("text", "back")
    return reads.join(back.select("session", "block", "back"), ["session", "block"]).select("session", "block", (F.col("text") == F.col("back")).alias("same"))
