"""Messages, tools, routing, stores and evaluations (inventory rows 3, 4, 7, 19, 39, 68, 70-72, 74, 76-79, 85, 87, 89, 92, 103, 107, 110, 141-143, 335, 339, 343, 345, 361, 376, 378, 411, 444)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_units(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Rows 3, 4, 76: ``calls(conv_id, turn, call_id)``, ``results(conv_id, turn, call_id)`` -> each call's turn with those that answer it."""
    r = results.select("conv_id", "call_id", F.col("turn").alias("answer"))
    return calls.join(r, ["conv_id", "call_id"]).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("answer")).alias("answers"))


def last_names(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Row 77: results with the name of their call; of repeated ids the last call counts."""
    names = calls.groupBy("call_id").agg(F.max_by("name", "turn").alias("name"))
    return results.join(names, "call_id", "left")


def zipped(originals: DataFrame, compressed: DataFrame) -> DataFrame:
    """Row 78: texts by place, only of requests with equally many on either side."""
    n = lambda df, name: df.groupBy("request").agg(F.count("*").alias(name))
    same = n(originals, "a").join(n(compressed, "b"), "request").where("a = b").select("request")
    return originals.join(same, "request", "left_semi").join(compressed, ["request", "place"])


def marker_hashes(texts: DataFrame, key: str, text: Column, pattern: str = r"hash=([0-9a-f]{16})") -> DataFrame:
    """Rows 79 and 411: every hash that a text names, once."""
    return texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("hash"))


def likely_typos(names: DataFrame, group: Sequence[str], name: str, key: str) -> DataFrame:
    """Row 85: pairs of a group whose names differ by at most two letters or a third of the longer one.

    Different names of a group are compared once, whatever the number of their rows; then each pair of names stands for the pairs of its rows.
    """
    rows = names.where(F.col(name).isNotNull()).select(*group, F.col(name).alias("name"), F.col(key).alias("key"))
    kinds = rows.select(*group, "name").distinct()
    one, other = (kinds.withColumnRenamed("name", f"name_{x}") for x in "ab")
    most = F.greatest(F.lit(2), F.floor(F.greatest(F.length("name_a"), F.length("name_b")) / 3)).cast("int")
    alike = one.join(other, list(group)).where((F.col("name_a") <= F.col("name_b")) & (F.levenshtein("name_a", "name_b") <= most))
    a, b = (rows.withColumnsRenamed({"name": f"name_{x}", "key": x}) for x in "ab")
    both = alike.join(a, [*group, "name_a"]).join(b, [*group, "name_b"])
    # rows of one name meet in both orders, those of two names in one
    wanted = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("name_a") != F.col("name_b")))
    return both.where(wanted).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def without_contradictions(rules: DataFrame) -> DataFrame:
    """Row 87: rules ``a, b`` but for those whose reverse is there too."""
    return rules.join(rules.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), ["a", "b"], "left_anti")


def captures(direct: DataFrame, proxied: DataFrame, by: str, order: str) -> DataFrame:
    """Row 89: exchanges of a route paired by their turn; what one side lacks is null."""
    turn = lambda df, name: df.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("turn"), F.col(order).alias(name))
    return turn(direct, "direct").join(turn(proxied, "proxied"), [by, "turn"], "full_outer")


def first_match(rows: DataFrame, candidates: Column, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Row 92: the value of the first of a row's candidate names that the dimension knows."""
    tried = rows.select("id", F.posexplode(candidates).alias("place", key)).join(dimension.select(key, value), key)
    best = tried.groupBy("id").agg(F.min_by(value, "place").alias(value))
    return rows.join(best, "id", "left")


def last_write_wins(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Row 7: the newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def routed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Row 68: the target of the first rule that holds: ``rule_no, model, least, most, tools, target``; a null condition holds always.

    Rules are a handful, so they are sent to the requests.
    """
    r, q = F.broadcast(rules.withColumnRenamed("model", "rule_model")), requests
    holds = (F.col("rule_model").isNull() | (F.col("rule_model") == F.col("model"))) & (F.col("least").isNull() | (F.col("tokens") >= F.col("least"))) & (F.col("most").isNull() | (F.col("tokens") <= F.col("most"))) & (F.col("tools").isNull() | (F.col("tools") == F.col("has_tools")))
    hit = q.join(r, holds, "left").groupBy(*q.columns).agg(F.min_by("target", "rule_no").alias("target"))
    return hit.withColumn("target", F.coalesce("target", "model"))


def excluded(name: Column, patterns: Sequence[str]) -> Column:
    """Row 39: case-insensitive names and globs of ``*`` and ``?``."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        out = out | F.lower(name).rlike(fnmatch.translate(p.lower()).replace("(?s:", "(?s:^").replace(r"\z", r"\Z"))
    return out


def decision(bypassed: Column, tokens: Column, floor: int, supported: Column) -> Column:
    """Rows 70-72: the first reason not to compress, else ``compress``."""
    return F.when(bypassed, "bypass").when(~supported, "unsupported").when(tokens < floor, "too_small").otherwise("compress")


def endpoint(path: Column) -> Column:
    """Row 74."""
    return F.when(path.rlike(r"/v1/messages$"), "messages").when(path.rlike(r"/chat/completions$"), "chat").when(path.rlike(r"/responses$"), "responses").otherwise("other")


def without_tracking(url: Column) -> Column:
    """Row 19: a URL without tracking parameters, the rest byte for byte; signed URLs stay whole."""
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    anchor = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"(?i)^(utm_[a-z]+|gclid|fbclid|ref|mc_eid|igshid)(=|$)"))
    clean = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), anchor)
    return F.when(~url.contains("?") | query.rlike(r"(?i)(^|&)(signature|sig|x-amz-signature|token)="), url).otherwise(clean)


def top_or_other(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Row 110: the keys with the largest sums, the rest as one."""
    sums = rows.groupBy(key).agg(F.sum(value).alias(value))
    kept = sums.orderBy(F.desc(value), key).limit(most).select(F.col(key).alias("_k"))
    named = sums.join(F.broadcast(kept), F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("_k", F.lit("other")))
    return named.groupBy(key).agg(F.sum(value).alias(value))


def breakdown(rows: DataFrame, key: Column) -> DataFrame:
    """Row 103: counts by key as one JSON object."""
    each = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return each.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("counts"))


def unexpired(rows: DataFrame, created: str, seconds: Column, now: Column) -> DataFrame:
    """Rows 107 and 378."""
    return rows.where(F.unix_micros(F.col(created).cast("timestamp")) + seconds * 1_000_000 > F.unix_micros(now))


def probe_report(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Row 141: of each dimension how many targets a text still has, can recover, and had in all.

    ``events(id, text, stored)``, ``targets(id, dimension, target)``.
    """
    both = targets.join(events, "id")
    kept = F.col("text").contains(F.col("target"))
    return both.groupBy("dimension").agg(F.count("*").alias("total"), F.count_if(kept).alias("retained"), F.count_if(~kept & F.col("stored").contains(F.col("target"))).alias("recoverable"))


def grid(payloads: DataFrame, carriers: DataFrame, positions: Sequence[str], survives: Column) -> DataFrame:
    """Row 142: every payload in every carrier at every place: three short fixed lists; survival by class."""
    places = F.explode(F.array(*(F.lit(p) for p in positions))).alias("position")
    every = payloads.crossJoin(F.broadcast(carriers)).select("*", places)
    text = F.when(F.col("position") == "start", F.concat_ws(" ", "payload", "carrier")).when(F.col("position") == "end", F.concat_ws(" ", "carrier", "payload")).otherwise(F.concat_ws(" ", "carrier", "payload", "carrier"))
    return every.withColumn("text", text).groupBy("class", "position").agg(F.count("*").alias("cases"), F.count_if(survives).alias("survived"))


def suite(cases: DataFrame) -> DataFrame:
    """Row 143: mean scores and kept answers by category and overall."""
    return cases.rollup("category").agg(F.count("*").alias("cases"), F.round(F.avg("f1"), 6).alias("f1"), F.count_if("same").alias("same"))


def compared(baseline: DataFrame, treated: DataFrame, key: str, value: str) -> DataFrame:
    """Row 444."""
    b = baseline.select(key, F.col(value).alias("before"))
    return b.join(treated.select(key, F.col(value).alias("after")), key).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def shortest_path(edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """Row 335: ``path`` with the fewest steps, the smallest of equal ones; no row beyond ``depth``.

    A round joins the newest nodes only, each with its best path.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen = front.select("id")
    for _ in range(depth + 1):
        hit = front.where(F.col("id") == target).select("path")
        if hit.limit(1).count():
            return hit
        step = both.join(front, F.col("a") == F.col("id")).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti")
        seen = seen.union(front.select("id"))
    return hit.limit(0)


def bubbled(memories: DataFrame, least: float) -> DataFrame:
    """Row 339: important memories of a session also for the whole user, naming where they came from."""
    up = memories.where(F.col("session_id").isNotNull() & (F.col("importance") >= least)).withColumns({"promoted_from": F.col("session_id"), "session_id": F.lit(None).cast("long")})
    return memories.withColumn("promoted_from", F.lit(None).cast("long")).unionByName(up)


def accessed(memories: DataFrame, reads: DataFrame) -> DataFrame:
    """Row 343: one access more for every id that was read, at its last time."""
    last = reads.groupBy("id").agg(F.max("at").alias("at"))
    joined = memories.join(last, "id", "left")
    return joined.select("id", (F.col("accesses") + F.col("at").isNotNull().cast("long")).alias("accesses"), F.coalesce("at", "last_accessed").alias("last_accessed"))


def stale(memories: DataFrame, files: DataFrame) -> DataFrame:
    """Row 345: memories that name a file that is gone."""
    return memories.select("id", F.explode("refs").alias("file")).join(files, "file", "left_anti").select("id").distinct()


def breakpoints(sections: DataFrame, by: str, most: int = 4, floor: int = 1024) -> DataFrame:
    """Row 361: the first sections whose end has so many tokens before it, in the order of their kinds.

    Columns: place (order of kinds), tokens, cacheable.
    """
    w = Window.partitionBy(by).orderBy("place")
    ends = sections.withColumn("upto", F.sum("tokens").over(w)).where(F.col("cacheable") & (F.col("upto") >= floor))
    return ends.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("place"))).where(F.col("rank") <= most)


def lineage(requests: DataFrame, chains: DataFrame) -> DataFrame:
    """Row 376: the longest recorded chain that begins a request's history, ``session, id, prefixes (hashes by length)``."""
    each = requests.select("session", "id", F.explode("prefixes").alias("hash"))
    found = each.join(chains, ["session", "hash"]).groupBy("session", "id").agg(F.max_by("chain", F.struct("length", "chain")).alias("chain"))
    return requests.select("session", "id").join(found, ["session", "id"], "left")
