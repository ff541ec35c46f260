"""Unified and combined diffs as files, hunks and lines, and their reduction (inventory rows 20, 246, 257).

Lines are told apart by a pattern and by what stands before them: a file begins with a line ``diff --git``, ``--cc`` or ``--combined``, a
hunk with a line of ``@``.  Windows and groups are those of one text, one file or one hunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.lines import exploded

FILE = r"(?s)^diff --(git a/.+ b/.+|combined .+|cc .+)\z"
#: As many parents as there are signs, less one.
HUNK = r"^(@{2,})( -[0-9]+(,[0-9]+)?)+ \+[0-9]+(,[0-9]+)? \1"
OLD, NEW = r"(?s)^--- (a/.+|/dev/null)\z", r"(?s)^\+\+\+ (b/.+|/dev/null)\z"
RENAME = r"^(rename|similarity|copy|dissimilarity) "
BINARY = r"(?s)^Binary files .+ differ\z"
INDEX = r"^index [0-9a-f]+(,[0-9a-f]+)*\.\.[0-9a-f]+( [0-7]+)?\z"
# fixed values: what makes a hunk matter
CHANGE, CHANGES_AT_MOST, WORD, PRIORITY = 0.03, 0.3, 0.2, 0.3
PRIORITIES = (
    r"\b(error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic)\b",
    r"\b(important|note|todo|fixme|hack|xxx|bug|fix)\b",
    r"\b(security|auth|password|secret|token)\b",
)
#: A diff of fewer lines stays whole; one that keeps less than this share of its lines says where the whole is.
LEAST_LINES, WORTH = 50, 0.8


def without_index(text: Column) -> Column:
    """Row 246: the diff without its lines of object names."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(INDEX)), "\n")


def diff_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, line, file, hunk, at, kind``: file and hunk from 1, 0 outside; ``at`` is the place in the hunk, from 0.

    Kinds: pre (before the first file), file, old, new, meta (other lines above a file's hunks), hunk, add, del, context, other.
    Inside a hunk a line of a plus or minus is a change whatever follows it.
    """
    lines = exploded(texts.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)), key, text)
    w = Window.partitionBy(key).orderBy("n")
    filed = lines.withColumn("file", F.sum(F.col("line").rlike(FILE).cast("int")).over(w))
    within = Window.partitionBy(key, "file").orderBy("n")
    is_hunk = F.col("line").rlike(HUNK) & (F.col("file") > 0)
    hunked = filed.withColumn("hunk", F.sum(is_hunk.cast("int")).over(within)).withColumn("at", F.row_number().over(Window.partitionBy(key, "file", "hunk").orderBy("n")) - 2)
    line, first = F.col("line"), F.substring("line", 1, 1)
    outside = F.when(line.rlike(FILE), "file").when(line.rlike(OLD), "old").when(line.rlike(NEW), "new").otherwise("meta")
    inside = F.when(first == "+", "add").when(first == "-", "del").when((first == " ") | (line == ""), "context").otherwise("other")
    kind = F.when(F.col("file") == 0, "pre").when(is_hunk, "hunk").when(F.col("hunk") == 0, outside).otherwise(inside)
    return hunked.withColumn("kind", kind)


def parsed_diffs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Row 20: ``key, pre, files`` of every text that has a file.

    pre is an array of lines; a file is a struct of its header, old and new marker (null without), flags, other lines and hunks; a hunk is a
    struct of its header, counts and lines.
    """
    lines = diff_lines(texts, key, text)
    ordered = lambda cond, name: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("n", "line")))), lambda x: x["line"]).alias(name)
    kind = lambda *names: F.col("kind").isin(*names)
    count = lambda name: F.count_if(kind(name))
    hunk = lines.where("hunk > 0").groupBy(key, "file", "hunk").agg(F.max(F.when(kind("hunk"), F.col("line"))).alias("header"), count("add").alias("additions"), count("del").alias("deletions"), count("context").alias("context"), ordered(~kind("hunk"), "lines"))
    hunks = hunk.groupBy(key, "file").agg(F.transform(F.sort_array(F.collect_list(F.struct("hunk", F.struct("header", "additions", "deletions", "context", "lines").alias("h")))), lambda x: x["h"]).alias("hunks"))
    meta = F.col("line")
    some = lambda pattern: F.coalesce(F.bool_or(kind("meta") & meta.rlike(pattern)), F.lit(False))
    one = lambda name: F.max(F.when(kind(name), F.col("line")))
    head = lines.where("file > 0 AND hunk = 0").groupBy(key, "file").agg(
        one("file").alias("header"), one("old").alias("old"), one("new").alias("new"), some("^new file mode").alias("is_new"), some("^deleted file mode").alias("is_deleted"), some(BINARY).alias("is_binary"), some(RENAME).alias("is_renamed"), ordered(kind("meta"), "meta")
    )
    whole = head.join(hunks, [key, "file"], "left").withColumn("hunks", F.coalesce("hunks", F.array().cast(hunks.schema["hunks"].dataType)))
    file = F.struct("header", "old", "new", "is_new", "is_deleted", "is_binary", "is_renamed", "meta", "hunks")
    files = whole.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("file", file.alias("f")))), lambda x: x["f"]).alias("files"))
    pre = lines.where("file = 0").groupBy(key).agg(ordered(F.lit(True), "pre"))
    return files.join(pre, key, "left").select(key, F.coalesce("pre", F.array().cast("array<string>")).alias("pre"), "files")


def hunk_scores(lines: DataFrame, key: str, query: DataFrame | None = None) -> DataFrame:
    """``key, file, hunk, additions, deletions, score``: changes, words of ``query(key, words)`` that the hunk holds, words of urgency; 1 at most."""
    own = F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != "hunk", F.struct("n", "line")))), lambda x: x["line"]), "\n"))
    hunks = lines.where("hunk > 0").groupBy(key, "file", "hunk").agg(F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"), own.alias("own"))
    urgent = reduce(Column.__or__, [F.col("own").rlike(p) for p in PRIORITIES])
    score = F.least(F.lit(CHANGES_AT_MOST), CHANGE * (F.col("additions") + F.col("deletions"))) + F.when(urgent, PRIORITY).otherwise(0.0)
    if query is not None:
        hunks = hunks.join(query.select(key, F.filter("words", lambda x: F.length(x) > 2).alias("words")), key, "left")
        score = score + WORD * F.coalesce(F.size(F.filter("words", lambda x: F.contains(F.col("own"), F.lower(x)))), F.lit(0))
    return hunks.select(key, "file", "hunk", "additions", "deletions", F.least(F.lit(1.0), score).alias("score"))


def reduced_diffs(texts: DataFrame, key: str, text: str, query: DataFrame | None = None, files: int = 20, hunks: int = 10, around: int = 2) -> DataFrame:
    """Row 257: ``key, text, hash, files, hunks, hunks_dropped`` of every text.

    Of more than ``files`` files those with most changes stay, of more than ``hunks`` hunks of a file the first, the last and the best scored;
    of a hunk the changes, ``around`` lines on either side and lines of a backslash, or its first ``around`` lines where it has
    no change.  Files and hunks keep their order; equal ones go by place.  Object names go, and the header of a plain change, which
    its markers repeat.  What was taken out is in the original, whose ``hash`` (else null) the last line names where less than
    ``WORTH`` of the lines is left.  Texts of fewer than ``LEAST_LINES`` lines or without a file stay as they are.
    """
    lines = diff_lines(texts, key, text)
    scores = hunk_scores(lines, key, query)
    order = Window.partitionBy(key, "file")
    ranked = scores.withColumns({"of": F.count("*").over(order), "edge": (F.col("hunk") == 1) | (F.col("hunk") == F.max("hunk").over(order))})
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(key, "file", "edge").orderBy(F.desc(F.round("score", 9)), "hunk")))
    keeps_hunk = (F.col("of") <= hunks) | F.col("edge") | (F.col("place") <= hunks - 2)
    by_file = scores.groupBy(key, "file").agg(F.sum("additions").alias("file_additions"), F.sum("deletions").alias("file_deletions"), F.count("*").alias("file_hunks"))
    every = lines.where("file > 0").select(key, "file").distinct().join(by_file, [key, "file"], "left").fillna(0)
    changes = F.col("file_additions") + F.col("file_deletions")
    placed = every.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(changes), "file"))).where(F.col("rank") <= files)
    kept = placed.join(ranked.where(keeps_hunk).select(key, "file", "hunk"), [key, "file"], "left")
    totals = kept.groupBy(key, "file").agg(F.first("file_additions").alias("a"), F.first("file_deletions").alias("d"), F.first("file_hunks").alias("all"), F.count("hunk").alias("k")).groupBy(key).agg(F.count("*").alias("files"), F.sum("a").alias("a"), F.sum("d").alias("d"), F.sum("k").alias("hunks"), (F.sum("all") - F.sum("k")).alias("hunks_dropped"))

    inside = Window.partitionBy(key, "file", "hunk").orderBy("at")
    change = F.col("kind").isin("add", "del")
    near = F.max(change.cast("int")).over(inside.rowsBetween(-around, around)) == 1
    changed = F.max(change.cast("int")).over(Window.partitionBy(key, "file", "hunk")) == 1
    body = lines.where("hunk > 0").withColumn("stays", (F.col("kind") == "hunk") | F.when(changed, near | F.col("line").startswith("\\")).otherwise(F.col("at") < around))
    body = body.where("stays").join(kept.where("hunk IS NOT NULL").select(key, "file", "hunk"), [key, "file", "hunk"], "left_semi")
    heads = lines.where("file > 0 AND hunk = 0").join(placed.select(key, "file"), [key, "file"], "left_semi")
    whole = Window.partitionBy(key, "file")
    of = lambda name: F.max(F.when(F.col("kind") == name, F.col("line"))).over(whole)
    path = F.regexp_extract(of("file"), r"(?s)^diff --git a/(.+) b/\1\z", 1)
    extended = F.max(((F.col("kind") == "meta") & ~F.col("line").rlike(INDEX)).cast("int")).over(whole) == 1
    plain = (path != "") & ~extended & (of("old") == F.concat(F.lit("--- a/"), path)) & (of("new") == F.concat(F.lit("+++ b/"), path))
    heads = heads.withColumn("goes", F.when(F.col("kind") == "file", F.coalesce(plain, F.lit(False))).otherwise((F.col("kind") == "meta") & F.col("line").rlike(INDEX))).where("NOT goes")
    shown = lines.where("file = 0").select(key, "n", "line").union(heads.select(key, "n", "line")).union(body.select(key, "n", "line"))
    left = shown.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("left"))
    omitted = F.when(F.col("hunks_dropped") > 0, F.concat(F.lit(", "), F.col("hunks_dropped").cast("string"), F.lit(" hunks omitted"))).otherwise("")
    foot = F.concat(F.lit("["), F.col("files").cast("string"), F.lit(" files changed, +"), F.col("a").cast("string"), F.lit(" -"), F.col("d").cast("string"), F.lit(" lines"), omitted, F.lit("]"))
    found = left.join(totals, key).withColumns({"short": F.concat(F.array_join("left.line", "\n"), F.lit("\n"), foot), "size": F.size("left") + 1})

    named = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("whole")).withColumn("before", F.size(F.split("whole", "\n", -1)))
    met = named.join(found, key, "left").withColumn("reduced", (F.col("before") >= LEAST_LINES) & F.col("files").isNotNull())
    worth = F.col("reduced") & (F.col("size") < WORTH * F.col("before"))
    hash_ = F.substring(F.md5("whole"), 1, 24)
    mark = F.concat(F.lit("\n["), F.col("before").cast("string"), F.lit(" lines compressed to "), F.col("size").cast("string"), F.lit(". Retrieve full diff: hash="), hash_, F.lit("]"))
    out = F.when(F.col("reduced"), F.concat("short", F.when(worth, mark).otherwise(""))).otherwise(F.col("whole"))
    n = lambda c: F.when(F.col("reduced"), F.col(c)).alias(c)
    return met.select(key, out.alias("text"), F.when(worth, hash_).alias("hash"), n("files"), n("hunks"), n("hunks_dropped"))
