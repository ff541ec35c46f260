"""Queries of diffs, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import diffs
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import table


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of diffs, twenty-five ids to a diff: plain changes, new, renamed and binary files; hunks of six lines."""
    d = table(spark, sf_dir, "documents").withColumns({"p": F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")), "k": F.col("doc_id") % 9})
    lines = lambda *parts: F.concat_ws("\n", *[F.concat(*[F.lit(x) if x != "p" else F.col("p") for x in part]) for part in parts])
    head = (
        F.when(F.col("k") == 0, lines(("diff --git a/", "p", " b/", "p"), ("new file mode 100644",), ("index 00..ab",), ("--- /dev/null",), ("+++ b/", "p")))
        .when(F.col("k") == 1, lines(("diff --git a/old/", "p", " b/", "p"), ("similarity index 90%",), ("rename from old/", "p"), ("rename to ", "p"), ("--- a/old/", "p"), ("+++ b/", "p")))
        .when(F.col("k") == 2, lines(("diff --git a/", "p", " b/", "p"), ("index 00..ab",), ("Binary files a/", "p", " and b/", "p", " differ")))
        .otherwise(lines(("diff --git a/", "p", " b/", "p"), ("index 00..ab 100644",), ("--- a/", "p"), ("+++ b/", "p")))
    )
    start = lambda i: (i + 1).cast("string")
    sign = lambda i: F.when(i % 5 == 0, "-").when(i % 5 == 1, "+").otherwise(" ")
    body = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 6 == 0, F.concat(F.lit("@@ -"), start(i), F.lit(",6 +"), start(i), F.lit(",6 @@\n"))).otherwise(""), sign(i), x))
    piece = F.when(F.col("k") == 2, head).otherwise(F.concat(head, F.lit("\n"), F.array_join(body, "\n")))
    each = d.select(F.floor(F.col("doc_id") / 25).cast("long").alias("id"), F.struct("doc_id", piece.alias("piece")).alias("f"))
    return each.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("f"))["piece"], "\n").alias("diff"))


_DIFFS = r"""f AS (
  SELECT doc_id // 25 AS id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id) AS file, doc_id % 9 AS k, 'src/' || doc_id || '.txt' AS p, string_split(text, chr(10)) AS l FROM documents
), line AS (SELECT id, file, unnest(range(len(l))) AS n, unnest(l) AS body FROM f WHERE k <> 2),
signed AS (SELECT id, file, n, n // 6 + 1 AS hunk, n % 6 AS spot, n % 5 IN (0, 1) AS change, CASE n % 5 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END || body AS line FROM line)"""


@query(f"""WITH {_DIFFS}, c AS (SELECT id, file, max(hunk) AS hunks, count(*) FILTER (n % 5 = 1) AS additions, count(*) FILTER (n % 5 = 0) AS deletions, count(*) AS lines FROM signed GROUP BY ALL)
SELECT f.id, CAST(f.file AS INTEGER) AS file, p AS path, k = 0 AS is_new, k = 1 AS is_renamed, k = 2 AS is_binary, CAST(coalesce(hunks, 0) AS INTEGER) AS hunks, CAST(coalesce(additions, 0) AS BIGINT) AS additions, CAST(coalesce(deletions, 0) AS BIGINT) AS deletions, CAST(coalesce(lines, 0) AS BIGINT) AS lines FROM f LEFT JOIN c USING (id, file)""")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 20."""
    files = diffs.parsed_diffs(_diffs(spark, sf_dir), "id", "diff").select("id", F.posexplode("files").alias("at", "f"))
    total = lambda value: F.aggregate("f.hunks", F.lit(0).cast("long"), lambda s, h: s + value(h))
    return files.select(
        "id", (F.col("at") + 1).alias("file"), F.regexp_extract("f.header", " b/(.*)$", 1).alias("path"), "f.is_new", "f.is_renamed", "f.is_binary",
        F.size("f.hunks").alias("hunks"), total(lambda h: h["additions"]).alias("additions"), total(lambda h: h["deletions"]).alias("deletions"), total(lambda h: F.size(h["lines"]).cast("long")).alias("lines"),
    )


@query(r"""SELECT doc_id // 25 AS id, CAST(sum(CASE WHEN doc_id % 9 = 1 THEN 6 WHEN doc_id % 9 = 2 THEN 2 WHEN doc_id % 9 = 0 THEN 4 ELSE 3 END + CASE WHEN doc_id % 9 = 2 THEN 0 ELSE len(string_split(text, chr(10))) + (len(string_split(text, chr(10))) + 5) // 6 END) AS INTEGER) AS lines FROM documents GROUP BY 1""")
def diffs_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 246: lines that are left."""
    return _diffs(spark, sf_dir).select("id", F.size(F.split(diffs.without_index(F.col("diff")), "\n", -1)).alias("lines"))


_URGENT = r"\b(error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic|important|note|todo|fixme|hack|xxx|bug|fix|security|auth|password|secret|token)\b"


@query(rf"""WITH {_DIFFS}, h AS (
  SELECT id, file, hunk, count(*) FILTER (change) AS changes, least(1.0, least(0.3, 0.03 * count(*) FILTER (change)) + CASE WHEN regexp_matches(lower(string_agg(line, chr(10) ORDER BY n)), '{_URGENT}') THEN 0.3 ELSE 0 END) AS score FROM signed GROUP BY ALL
), r AS (SELECT *, count(*) OVER w AS all_, hunk = 1 OR hunk = max(hunk) OVER w AS edge FROM h WINDOW w AS (PARTITION BY id, file)),
pick AS (SELECT id, file, hunk FROM (SELECT *, row_number() OVER (PARTITION BY id, file, edge ORDER BY round(score, 9) DESC, hunk) AS place FROM r) WHERE all_ <= 10 OR edge OR place <= 8),
ff AS (SELECT f.*, coalesce(c.changes, 0) AS changes, coalesce(c.hunks, 0) AS hunks, coalesce(adds, 0) AS adds, coalesce(dels, 0) AS dels FROM f
  LEFT JOIN (SELECT id, file, sum(changes) AS changes, count(*) AS hunks FROM h GROUP BY ALL) c USING (id, file)
  LEFT JOIN (SELECT id, file, count(*) FILTER (n % 5 = 1) AS adds, count(*) FILTER (n % 5 = 0) AS dels FROM signed GROUP BY ALL) d USING (id, file)),
keep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changes DESC, file) AS place FROM ff) WHERE place <= 20),
near AS (SELECT *, max(CAST(change AS INT)) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, max(CAST(change AS INT)) OVER (PARTITION BY id, file, hunk) AS any_ FROM signed WINDOW w AS (PARTITION BY id, file, hunk ORDER BY n)),
body AS (SELECT id, file, hunk, min(n) AS n, count(*) + 1 AS lines, '@@ -' || ((hunk - 1) * 6 + 1) || ',6 +' || ((hunk - 1) * 6 + 1) || ',6 @@' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS t
  FROM near JOIN pick USING (id, file, hunk) WHERE CASE WHEN any_ = 1 THEN near = 1 ELSE spot < 2 END GROUP BY id, file, hunk),
bodies AS (SELECT id, file, string_agg(t, chr(10) ORDER BY hunk) AS t, sum(lines) AS lines, count(*) AS hunks FROM body GROUP BY ALL),
pieces AS (SELECT k.id, k.file, k.hunks AS all_hunks, coalesce(b.hunks, 0) AS kept, adds, dels,
  CASE k WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 2 END + coalesce(lines, 0) AS lines,
  CASE k WHEN 0 THEN 'diff --git a/' || p || ' b/' || p || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || p
         WHEN 1 THEN 'diff --git a/old/' || p || ' b/' || p || chr(10) || 'similarity index 90%' || chr(10) || 'rename from old/' || p || chr(10) || 'rename to ' || p || chr(10) || '--- a/old/' || p || chr(10) || '+++ b/' || p
         WHEN 2 THEN 'diff --git a/' || p || ' b/' || p || chr(10) || 'Binary files a/' || p || ' and b/' || p || ' differ'
         ELSE '--- a/' || p || chr(10) || '+++ b/' || p END || coalesce(chr(10) || t, '') AS t
  FROM keep k LEFT JOIN bodies b USING (id, file)),
w AS (SELECT id, string_agg(t, chr(10) ORDER BY file) || chr(10) || '[' || count(*) || ' files changed, +' || sum(adds) || ' -' || sum(dels) || ' lines' || CASE WHEN sum(all_hunks) > sum(kept) THEN ', ' || (sum(all_hunks) - sum(kept)) || ' hunks omitted' ELSE '' END || ']' AS t,
  sum(lines) + 1 AS lines, count(*) AS files, sum(kept) AS hunks, sum(all_hunks) - sum(kept) AS hunks_dropped FROM pieces GROUP BY 1),
before AS (SELECT doc_id // 25 AS id, sum(CASE doc_id % 9 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 4 END + CASE WHEN doc_id % 9 = 2 THEN 0 ELSE len(string_split(text, chr(10))) + (len(string_split(text, chr(10))) + 5) // 6 END) AS n FROM documents GROUP BY 1)
SELECT id, CAST(files AS BIGINT) AS files, CAST(hunks AS BIGINT) AS hunks, CAST(hunks_dropped AS BIGINT) AS hunks_dropped, lines < 0.8 * n AS offloaded, length(t) AS size, md5(t) AS hash FROM w JOIN before USING (id) WHERE n >= 50""")
def reduced_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 246, 257: diffs of fifty lines or more, reduced, without the line that names the original."""
    r = diffs.reduced_diffs(_diffs(spark, sf_dir), "id", "diff").where("files IS NOT NULL")
    t = F.regexp_replace("text", r"\n\[[0-9]+ lines compressed to [^\n]*\]\z", "")
    return r.select("id", "files", "hunks", "hunks_dropped", F.col("hash").isNotNull().alias("offloaded"), F.length(t).cast("long").alias("size"), F.md5(t).alias("hash"))
