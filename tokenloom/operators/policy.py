"""What may be touched in a request, how commands and turns are told apart, what is learnt and kept (inventory rows 36, 37, 56, 61, 62, 67, 73, 86, 99, 106, 186, 194, 199)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns by which memories may be ordered.
ORDERS = ("created_at", "importance", "access_count", "last_accessed")
#: Programs that print a file as it is.
READERS = "cat|head|tail|nl|bat|less|more"
#: Files that tools write and nobody edits.
LOCKFILES = (
    r"bun\.lock|bun\.lockb|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|uv\.lock|poetry\.lock|Pipfile\.lock|requirements\.txt\.lock|Cargo\.lock|go\.sum|Gemfile\.lock|"
    r"composer\.lock|flake\.lock|Package\.resolved|gradle\.lockfile|packages\.lock\.json"
)
#: Words of commands that say nothing of their purpose.
NOISE = ("head", "tail", "cat", "grep", "awk", "sed", "sort", "uniq", "wc", "xargs", "find")


def page(memories: DataFrame, order: str, key: str, limit: int, offset: int = 0, descending: bool = True) -> DataFrame:
    """Row 36: a page of memories by one of ``ORDERS``; ties by ``key``, nulls last; other columns are refused."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    return memories.orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), key).offset(offset).limit(limit)


def same_json(a: Column, b: Column) -> Column:
    """Row 37: equal in type and structure: the order of fields doesn't matter, that of elements does, 1 is not "1" nor true; false for text that is no JSON."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def never_blank(original: Column, reduced: Column) -> Column:
    """Row 56: the original where a reduction leaves nothing of a text that had something."""
    return F.when((F.trim(F.coalesce(reduced, F.lit(""))) == "") & (F.trim(original) != ""), original).otherwise(reduced)


def frozen_floor(messages: DataFrame, by: str, order: str, marked: Column) -> DataFrame:
    """Row 61: how many leading messages the last marked one fixes; 0 without one."""
    return messages.groupBy(by).agg(F.coalesce(F.max(F.when(marked, F.col(order))) + 1, F.lit(0)).alias("frozen"))


def stable_prefix(messages: DataFrame, by: str, order: str, stable: Column) -> DataFrame:
    """Row 61: leading messages before the first unstable one, never the last message.  Places count from 0."""
    first, n = F.min(F.when(~F.coalesce(stable, F.lit(False)), F.col(order))), F.count("*")
    return messages.groupBy(by).agg(F.least(F.coalesce(first, n), n - 1).alias("frozen"))


def live_zone(messages: DataFrame, floors: DataFrame, by: str, order: str, text: str, least: int = 512) -> DataFrame:
    """Row 62: the latest user message of each request where it lies at or beyond the frozen floor and has so many bytes."""
    latest = messages.where("role = 'user'").groupBy(by).agg(F.max(order).alias(order))
    zone = messages.join(latest, [by, order], "left_semi").join(floors, by, "left")
    return zone.where((F.col(order) >= F.coalesce("frozen", F.lit(0))) & (F.octet_length(text) >= least) & (F.col("role") == "user")).drop("frozen")


def reads_file(command: Column) -> Column:
    """Row 67: whether a shell command prints a file as it is: no writing, no lockfile; ``sed`` with ``-n`` only.

    Leading changes of folder, assignments, ``sudo``, ``env`` and ``timeout`` are looked through.
    """
    bare = F.regexp_replace(F.trim(command), r"^(cd\s+\S+\s*(&&|;)\s*)+", "")
    bare = F.regexp_replace(bare, r"^((sudo|env)\s+|timeout\s+\S+\s+|[A-Za-z_]\w*=\S*\s+)+", "")
    writes = bare.rlike(r"(^|\s)(>>?|tee\b|<<)")
    reads = bare.rlike(rf"^(\S*/)?({READERS})(\s|$)") | (bare.rlike(r"^(\S*/)?sed\s") & bare.rlike(r"\s-n(\s|$)"))
    return F.coalesce(reads & ~writes & ~bare.rlike(rf"(?i)(^|[\s/])({LOCKFILES})(\s|$)"), F.lit(False))


def turn_kinds(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Row 73: what a request's last message is: new_ask, continuation (results only), error_continuation or unknown.

    Columns: role, kind (text, image, document, tool_result), is_error; a message has a row a block.
    """
    last = blocks.join(blocks.groupBy(by).agg(F.max(order).alias(order)), [by, order], "left_semi")
    signs = last.groupBy(by).agg(
        F.bool_and(F.col("role") == "user").alias("user"), F.bool_or(F.col("kind").isin("text", "image", "document")).alias("asks"), F.bool_or((F.col("kind") == "tool_result") & F.col("is_error")).alias("fails"), F.bool_or(F.col("kind") == "tool_result").alias("results")
    )
    kind = F.when(~F.coalesce("user", F.lit(False)), "unknown").when(F.col("asks"), "new_ask").when(F.col("fails"), "error_continuation").when(F.col("results"), "continuation").otherwise("unknown")
    return signs.select(by, kind.alias("kind"))


def retried(failed: Column, success: Column, share: float = 0.4) -> Column:
    """Row 86: whether a command looks like another one corrected: the same program and either few edits or a telling word in common."""
    program = lambda c: F.split(F.trim(c), r"\s+")[0]
    telling = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: (F.length(w) >= 5) & ~w.startswith("-") & (w != program(c)) & ~F.lower(w).isin(*NOISE))
    close = F.levenshtein(failed, success) <= share * F.greatest(F.length(failed), F.length(success))
    return F.coalesce((F.trim(failed) != "") & (failed != success) & (program(failed) == program(success)) & (close | F.arrays_overlap(telling(failed), telling(success))), F.lit(False))


def retries(calls: DataFrame, by: str, order: str, reach: int = 5) -> DataFrame:
    """Row 86: the nearest failed call of the last ``reach`` that each successful one corrects.  Columns: command, failed."""
    w = Window.partitionBy(by).orderBy(order)
    earlier = [F.struct(F.lag(order, k).over(w).alias("at"), F.lag("command", k).over(w).alias("command"), F.lag("failed", k).over(w).alias("failed")) for k in range(1, reach + 1)]
    rows = calls.select(by, order, "command", "failed", F.array(*earlier).alias("earlier")).where("NOT failed")
    hits = F.filter("earlier", lambda e: F.coalesce(e["failed"], F.lit(False)) & retried(e["command"], F.col("command")))
    return rows.withColumn("hits", hits).where(F.size("hits") > 0).select(by, order, F.col("hits")[0]["at"].alias("corrects"))


def block_tokens(blocks: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """Row 99: tokens of each request by kind of block; 0 for absent kinds."""
    return blocks.groupBy(by).pivot("kind", kinds).agg(F.sum("tokens")).fillna(0, kinds)


def ranked(buckets: DataFrame, key: str) -> DataFrame:
    """Row 106: buckets by cost, then by tokens saved, then by key; a global sort by ranges, so no task holds all of them."""
    return buckets.orderBy(F.desc("cost"), F.desc("saved"), key)


def capped(sections: DataFrame, by: str, order: str, cap: int, fixed: int = 0) -> DataFrame:
    """Row 186: sections ``by, order, saved, cost`` left when those worth least, the latest of equal ones first, go until all fit; the best always stays."""
    own, worst = Window.partitionBy(by), Window.partitionBy(by).orderBy("saved", F.desc(order))
    rows = sections.withColumns({"_total": F.sum("cost").over(own) + fixed, "_gone": F.coalesce(F.sum("cost").over(worst.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_left": F.count("*").over(own) - F.row_number().over(worst)})
    return rows.where((F.col("_total") - F.col("_gone") <= cap) | (F.col("_left") == 0)).drop("_total", "_gone", "_left")


def others(candidates: DataFrame, kept: DataFrame, *key: str) -> DataFrame:
    """Row 194: candidates that aren't kept yet."""
    return candidates.join(kept.select(*key).distinct(), list(key), "left_anti")


def merged_sections(new: DataFrame, prior: DataFrame, heading: Column) -> DataFrame:
    """Row 199: all new sections, and of the prior ones the first of each heading that no new one has; ``place`` orders either."""
    key = F.trim(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", " "))
    first = Window.partitionBy("_key").orderBy("place")
    carried = prior.withColumn("_key", F.coalesce(key, F.lit(""))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    carried = carried.join(new.select(F.coalesce(key, F.lit("")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")
    return new.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True)))
