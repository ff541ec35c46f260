"""Queries of folded texts, each beside DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import folds
from tokenloom.operators.lines import exploded, joined
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import LOG_LINES, log_lines, table


def _search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as rows of a search: files of three lines below a directory of the language and source."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws("/", "lang", "source").alias("dir"), "text")
    each = d.select("id", "dir", F.posexplode(F.split("text", "\n", -1)).alias("n", "body"))
    return each.select("id", "n", F.concat("dir", F.lit("/part"), F.floor(F.col("n") / 3).cast("string"), F.lit(".txt:"), (F.col("n") + 1).cast("string"), F.lit(":"), "body").alias("line"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each document: a path for each of its lines, five to a directory."""
    each = _search_rows(spark, sf_dir)
    return each.select("id", "n", F.concat(F.lit("corpus/group"), F.floor(F.col("n") / 5).cast("string"), F.lit("/line"), F.col("n").cast("string"), F.lit(".txt")).alias("line"))


_SEARCH = """rows_ AS (
  SELECT 's' || doc_id AS id, CAST(unnest(range(len(l))) AS BIGINT) AS n, unnest(l) AS body, lang || '/' || source AS dir FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)
), search AS (SELECT id, n, dir || '/part' || (n // 3) || '.txt:' || (n + 1) || ':' || body AS line FROM rows_)"""
_GREP = r"(?s)^(.*/)([^/:]+):(0|[1-9][0-9]{0,17}):(.*)\z"


def _escape(line: str, mark: str) -> str:
    return rf"""CASE WHEN regexp_matches({line}, '^\\*{mark}') THEN '\' || {line} ELSE {line} END"""


def _heading(of: str, to: str) -> str:
    """CTEs from ``of(id, n, line)`` to ``to(id, text)``."""
    return rf"""{to}_p AS (
  SELECT *, CASE WHEN regexp_matches(line, '{_GREP}') THEN regexp_extract(line, '{_GREP}', 1) ELSE nullif(regexp_extract(line, '(?s)^(.*/)[^/]*\z', 1), '') END AS prefix FROM {of}
), {to}_c AS (SELECT *, prefix IS DISTINCT FROM lag(prefix) OVER (PARTITION BY id ORDER BY n) AS changed FROM {to}_p),
{to}_r AS (SELECT *, sum(CAST(changed AND (n > 0 OR prefix IS NOT NULL) AS INT)) OVER (PARTITION BY id ORDER BY n) AS run FROM {to}_c),
{to}_h AS (SELECT *, CASE WHEN (count(*) OVER (PARTITION BY id, run) - 1) * length(prefix) > 6 THEN prefix ELSE '' END AS head FROM {to}_r),
{to}_f AS (
  SELECT *, CASE WHEN head = '' THEN coalesce(lag(head) OVER w, '') <> '' ELSE coalesce(lag(run) OVER w, -1) <> run END AS fresh, substr(line, length(head) + 1) AS rest
  FROM {to}_h WINDOW w AS (PARTITION BY id ORDER BY n)
), {to} AS (SELECT id, string_agg(CASE WHEN fresh THEN '» ' || head || chr(10) ELSE '' END || {_escape("rest", "»")}, chr(10) ORDER BY n) AS text FROM {to}_f GROUP BY 1)"""


def _tree(of: str, to: str) -> str:
    part = lambda k: f"CASE WHEN regexp_matches(line, '{_GREP}') THEN regexp_extract(line, '{_GREP}', {k}) END"
    return rf"""{to}_p AS (SELECT *, {part(1)} AS dir, {part(2)} AS file, CAST({part(3)} AS BIGINT) AS no, {part(4)} AS content FROM {of}),
{to}_l AS (SELECT *, lag(dir) OVER w AS dir0, lag(file) OVER w AS file0, lag(no) OVER w AS no0, lag(content) OVER w AS content0 FROM {to}_p WINDOW w AS (PARTITION BY id ORDER BY n)),
{to} AS (
  SELECT id, string_agg(CASE
    WHEN dir IS NULL THEN CASE WHEN dir0 IS NOT NULL THEN '»' || chr(10) ELSE '' END || {_escape("line", "»")}
    ELSE CASE WHEN dir IS DISTINCT FROM dir0 THEN '» ' || dir || chr(10) ELSE '' END
      || CASE WHEN dir IS DISTINCT FROM dir0 OR file IS DISTINCT FROM file0 THEN '»» ' || file || chr(10) || no || ':' || content
              ELSE CASE WHEN no = no0 + 1 THEN '' ELSE CAST(no AS VARCHAR) END || CASE WHEN content = content0 THEN '=' ELSE ':' || content END END
    END, chr(10) ORDER BY n) AS text FROM {to}_l GROUP BY 1)"""


def _block(of: str, to: str) -> str:
    return rf"""{to}_w AS (SELECT id, n, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS h FROM {of} WINDOW w AS (PARTITION BY id ORDER BY n)),
{to}_b AS (SELECT id, n, n - lag(n) OVER (PARTITION BY id, h ORDER BY n) AS back FROM {to}_w WHERE h IS NOT NULL),
{to}_a AS (SELECT *, coalesce(n - lag(n) OVER (PARTITION BY id, back ORDER BY n) > 3, true) AS begins FROM {to}_b WHERE back IS NOT NULL),
{to}_i AS (SELECT id, back, min(n) AS low, max(n) + 3 AS high FROM (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY id, back ORDER BY n) AS i FROM {to}_a) GROUP BY id, back, i),
{to}_o AS (SELECT id, n, max(o) AS o FROM (SELECT id, unnest(range(low, high)) AS n, {{'size': high - low, 'early': -low, 'near': -back}} AS o FROM {to}_i) GROUP BY ALL),
{to}_s AS (SELECT id, o, min(n) AS low, max(n) + 1 AS high FROM {to}_o GROUP BY ALL HAVING max(n) + 1 - min(n) >= 3),
{to} AS (
  SELECT l.id, string_agg(CASE WHEN s.low IS NULL THEN {_escape("line", "…")} ELSE '…' || (s.high - s.low) || '@-' || (-s.o.near) END, chr(10) ORDER BY l.n) AS text
  FROM {of} l LEFT JOIN {to}_s s ON s.id = l.id AND l.n >= s.low AND l.n < s.high WHERE s.low IS NULL OR s.low = l.n GROUP BY 1)"""


@query(f"""WITH {_SEARCH}, {_heading("search", "folded")} SELECT id, length(text) AS size, sha256(text) AS hash FROM folded""")
def directory_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 243."""
    return folds.heading_fold(_search_rows(spark, sf_dir), "id").select("id", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))


@query(f"""WITH {_SEARCH}, paths AS (SELECT id, n, 'corpus/group' || (n // 5) || '/line' || n || '.txt' AS line FROM rows_), {_heading("paths", "folded")} SELECT id, text FROM folded""")
def path_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 245."""
    return folds.heading_fold(_paths(spark, sf_dir), "id")


@query(f"""WITH {_SEARCH}, {_tree("search", "folded")} SELECT id, length(text) AS size, sha256(text) AS hash FROM folded""")
def search_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 244."""
    return folds.tree_fold(_search_rows(spark, sf_dir), "id").select("id", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines without what differs in each, a hundred to a log: whether a line is an error, a warning or neither."""
    return log_lines(spark, sf_dir).select(F.concat(F.lit("l"), F.col("log_id").cast("string")).alias("id"), (F.col("n") % 100).alias("n"), F.regexp_extract("line", "(ERROR|WARN|INFO)", 1).alias("line"))


_SHAPES = LOG_LINES + """, shapes AS (SELECT 'l' || log_id AS id, n % 100 AS n, regexp_extract(line, '(ERROR|WARN|INFO)', 1) AS line FROM log_lines)"""


@query(f"""WITH {_SHAPES}, {_block("shapes", "folded")} SELECT id, text FROM folded""")
def folded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 241."""
    return folds.block_fold(_shapes(spark, sf_dir), "id")


@query(rf"""WITH {_SEARCH}, {_SHAPES}, every AS (
  SELECT * FROM search UNION ALL SELECT * FROM shapes UNION ALL SELECT 'd' || substr(id, 2), n, body FROM rows_
), whole AS (SELECT id, string_agg(line, chr(10) ORDER BY n) AS text FROM every GROUP BY 1), {_heading("every", "hf")}, {_tree("every", "tf")}, {_block("every", "bf")},
found AS (SELECT '' AS fold, * FROM whole UNION ALL SELECT 'headings', * FROM hf UNION ALL SELECT 'tree', * FROM tf UNION ALL SELECT 'blocks', * FROM bf),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(text), fold) AS p FROM found)
SELECT id, coalesce(nullif(fold, ''), 'none') AS fold, length(text) AS size, sha256(text) AS hash FROM best WHERE p = 1""")
def smallest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 247, 408: documents, searches and logs, each by the fold that makes it smallest."""
    documents = table(spark, sf_dir, "documents")
    name = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string")).alias("id")
    row = lambda body, n: F.concat("dir", F.lit("/part"), F.floor(n / 3).cast("string"), F.lit(".txt:"), (n + 1).cast("string"), F.lit(":"), body)
    # the rows of _search_rows, put together where a document is
    search = documents.withColumn("dir", F.concat_ws("/", "lang", "source")).select(name("s"), F.array_join(F.transform(F.split("text", "\n", -1), row), "\n").alias("text"))
    texts = search.where("text IS NOT NULL").union(joined(_shapes(spark, sf_dir), "id", "n", F.col("line"), "text")).union(documents.select(name("d"), "text"))
    return folds.smallest_fold(texts, "id", "text").select("id", "fold", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))
