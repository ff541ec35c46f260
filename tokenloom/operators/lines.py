"""Texts as lines: folds, searches, logs (inventory rows 21, 40-47, 162, 240, 242, 250, 251, 254)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import DENSE, has_error_word, log_level, log_shape  # noqa: F401


def exploded(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, line`` from 0."""
    return texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))


def joined(lines: DataFrame, key: str, order: str, line: Column, name: str) -> DataFrame:
    """The lines of a key as one text again."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias(name))


def run_ids(lines: DataFrame, key: str, order: str, *same: Column) -> DataFrame:
    """Number of the run of neighbouring rows that agree in ``same``."""
    w = Window.partitionBy(key).orderBy(order)
    value = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(same)))
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    return lines.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


def collapse_runs(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Row 240: equal neighbouring lines as one with its count, where that is shorter; ``key, text``."""
    runs = run_ids(lines, key, "n", F.col("line")).groupBy(key, "run").agg(F.min("n").alias("n"), F.first("line").alias("line"), F.count("*").alias("times"))
    mark = F.concat(F.lit(" …x"), F.col("times").cast("string"))
    wins = (F.col("times") >= least) & ((F.col("times") - 1) * (F.length("line") + 1) > F.length(mark))
    shown = F.when(wins, F.concat("line", mark)).otherwise(F.array_join(F.array_repeat("line", F.col("times").cast("int")), "\n"))
    return joined(runs, key, "n", shown, "text")


def expand_runs(folded: Column) -> Column:
    """Inverse of ``collapse_runs`` for texts that had no such mark themselves."""
    times = lambda l: F.when(l.rlike(r" …x\d+$"), F.regexp_extract(l, r" …x(\d+)$", 1).cast("int")).otherwise(F.lit(1))  # noqa: E731, E741
    return F.array_join(F.transform(F.split(folded, "\n"), lambda l: F.array_join(F.array_repeat(F.regexp_replace(l, r" …x\d+$", ""), times(l)), "\n")), "\n")  # noqa: E741


def grep_rows(lines: DataFrame) -> DataFrame:
    """Row 21: ``path, line_no, content`` of ``path:line:content``, drive letters allowed."""
    pattern = r"^((?:[A-Za-z]:)?[^:]+):(\d+):(.*)$"
    return lines.where(F.col("line").rlike(pattern)).select("*", *(F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(("path", "line_no", "content")))).withColumn("line_no", F.col("line_no").cast("long"))


def heading_fold(rows: DataFrame, key: str) -> DataFrame:
    """Row 242: neighbouring matches of a file under its path once; ``key, text``."""
    w = Window.partitionBy(key).orderBy("n")
    fresh = ~F.col("path").eqNullSafe(F.lag("path").over(w))
    own = F.concat_ws(":", F.col("line_no").cast("string"), F.col("content"))
    return joined(rows.withColumn("shown", F.when(fresh, F.concat("path", F.lit("\n"), own)).otherwise(own)), key, "n", F.col("shown"), "text")


def top_matches(rows: DataFrame, key: str, score: Column, files: int = 15, each: int = 5) -> DataFrame:
    """Row 162: the files with the highest total score, of each the first, the last and the best matches."""
    scored = rows.withColumn("score", score)
    total = scored.groupBy(key, "path").agg(F.sum("score").alias("total"), F.min("n").alias("at"))
    kept = total.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "at"))).where(F.col("place") <= files).select(key, "path")
    from tokenloom.operators.sequences import first_last_best

    chosen = scored.join(kept, [key, "path"]).withColumn("_file", F.struct(key, "path"))
    return first_last_best(chosen, "_file", "n", "score", each).drop("_file")


def templates(lines: DataFrame, least: int = 3) -> DataFrame:
    """Rows 250 and 254: log lines that are equal once numbers and paths are masked."""
    shaped = lines.withColumn("template", log_shape(F.col("line")))
    return shaped.groupBy("template").agg(F.count("*").alias("lines"), F.min("line").alias("example")).where(F.col("lines") >= least)


def dedupe(lines: DataFrame, key: str) -> DataFrame:
    """Row 251: the first of equal lines, with where it occurs."""
    return lines.groupBy(key, "line").agg(F.min("n").alias("first"), F.array_sort(F.collect_list("n")).alias("at"))


def content_type(text: Column) -> Column:
    """Rows 40-47: the first kind of content whose signs are strong enough, else text.

    Numbers are the fixed weights and thresholds of the kinds: how sure a share of lines makes, and from when that is enough.
    """
    every = F.split(text, "\n")
    some = lambda n: F.filter(F.slice(every, 1, n), lambda x: F.trim(x) != "")
    count = lambda rows, pattern: F.size(F.filter(rows, lambda x: x.rlike(pattern)))
    ratio = lambda rows, pattern: F.when(F.size(rows) > 0, count(rows, pattern) / F.size(rows)).otherwise(0.0)
    head = F.substring(text, 1, 3000)
    tag = lambda t: head.rlike(rf"(?i)<{t}[\s>]").cast("double")
    html = 0.5 * head.rlike(r"(?i)<!doctype html").cast("double") + 0.3 * tag("html") + 0.1 * tag("head") + 0.1 * tag("body")
    first = F.slice(every, 1, 500)
    headers, changes = count(first, r"^(diff --git |diff --combined |diff --cc |--- a/|\+\+\+ b/|@@ -\d+)"), count(first, r"^[+-][^+-]")
    diff = F.when(headers > 0, F.least(F.lit(1.0), 0.5 + 0.2 * headers + 0.05 * changes)).otherwise(0.0)
    found = ratio(some(100), r"^[^\s:]+:\d+:")
    search = F.when(found >= 0.3, 0.4 + 0.6 * found).otherwise(0.0)
    logged = ratio(some(200), r"^\s*(\[?\d{4}-\d{2}-\d{2}|\[?(INFO|WARN|WARNING|ERROR|DEBUG|FATAL|CRITICAL)\b)")
    errors = count(some(200), r"\b(ERROR|FATAL|CRITICAL)\b")
    log = F.when(logged >= 0.1, F.least(F.lit(1.0), 0.3 + 0.5 * logged + 0.05 * errors)).otherwise(0.0)
    commas = F.transform(some(200), lambda x: F.size(F.split(x, ",")))
    tabular = (F.size(commas) >= 3) & (F.element_at(commas, 1) >= 3) & F.forall(commas, lambda n: n == F.element_at(commas, 1))
    is_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    return F.when(is_json, "json").when(diff >= 0.7, "diff").when(html >= 0.7, "html").when(search >= 0.6, "search").when(log >= 0.5, "log").when(tabular, "tabular").otherwise("text")
