"""What is learnt of tools and sessions: usage patterns, hints, caches, savings (inventory rows 93, 109, 112, 113, 117, 119, 121-125, 127, 135, 137, 139, 140, 152, 168, 172, 192, 195, 198, 341, 342, 355, 453)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of compressions fetched back from which a tool counts as often and as sometimes fetched, and of whole fetches.
OFTEN, SOMETIMES, WHOLE = 0.5, 0.2, 0.8
#: Fixed value: compressions from which hints are given.
LEAST_SAMPLES = 5


def patterns(compressions: DataFrame, by: list[str]) -> DataFrame:
    """Row 121: partial sums for each key of ``by`` over rows ``before, after, instance, retrieved, full``; all of them can be merged."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return compressions.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.avg("before").alias("mean_before"), count(F.col("retrieved")).alias("retrievals"),
        count(F.col("retrieved") & F.col("full")).alias("full_retrievals"), F.countDistinct("instance").alias("users"),
    )


def merged_patterns(*parts: DataFrame, by: list[str]) -> DataFrame:
    """Row 125: patterns of several stores as one: sums, and means weighted by their samples; users are the most that a store saw."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("samples", "before", "after", "retrievals", "full_retrievals")]
    return every.groupBy(*by).agg(*sums, (F.sum(F.col("mean_before") * F.col("samples")) / F.sum("samples")).alias("mean_before"), F.max("users").alias("users"))


def confidence(samples: Column, users: Column) -> Column:
    """Row 124: by samples up to 0.7, by users from three on up to 0.3, 0.95 in all at most."""
    return F.least(F.lit(0.95), F.least(F.lit(0.7), samples / 100) + F.when(users >= 3, F.least(F.lit(0.3), users * 0.03)).otherwise(0.0))


def recommendations(found: DataFrame, items_seen: Column) -> DataFrame:
    """Row 123: how many items to keep by how often they are fetched back; none are left out where nearly all fetches are whole."""
    rate = F.col("retrievals") / F.col("samples")
    skip = (rate > OFTEN) & (F.col("full_retrievals") / F.col("retrievals") > WHOLE)
    most = F.when(F.coalesce(skip, F.lit(False)), F.floor(items_seen / F.greatest(F.lit(1), F.col("samples")))).when(rate > OFTEN, 50).when(rate > SOMETIMES, 30).otherwise(20)
    return found.withColumns({"skip": F.coalesce(skip, F.lit(False)), "max_items": most.cast("long"), "confidence": confidence(F.col("samples"), F.col("users"))})


def top_fields(fetched: DataFrame, key: str, field: str, most: int = 5) -> DataFrame:
    """Rows 122, 123: the fields asked for most often, most frequent first."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), field)
    ranked = fetched.groupBy(key, field).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", field))).alias("f")).select(key, F.col(f"f.{field}").alias("fields"))


def hints(found: DataFrame) -> DataFrame:
    """Row 127: items to keep, items to suggest and aggressiveness for each tool; null where there are too few samples."""
    rate = F.col("retrievals") / F.col("samples")
    skip = (rate > OFTEN) & (F.col("full_retrievals") / F.col("retrievals") > WHOLE)
    known = F.col("samples") >= LEAST_SAMPLES
    pick = lambda high, middle, low: F.when(~known | F.coalesce(skip, F.lit(False)), None).when(rate > OFTEN, high).when(rate > SOMETIMES, middle).otherwise(low)
    return found.withColumns({"skip": known & F.coalesce(skip, F.lit(False)), "max_items": pick(50, 30, 15), "suggested": pick(40, 25, 10), "aggressiveness": pick(0.3, 0.5, 0.7)})


def looked_up(requests: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Row 93: each request with what is recommended for its exact key, nulls as keys of their own."""
    renamed = known.withColumnsRenamed({c: f"_k_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return requests.join(renamed, cond, "left").drop(*(f"_k_{c}" for c in on))


def snapshot(requests: DataFrame, key: str) -> DataFrame:
    """Row 109: tokens in and saved by key, the share saved of both in percent, ranked by what was saved."""
    sums = requests.groupBy(key).agg(F.sum("after").alias("tokens"), F.sum(F.col("before") - F.col("after")).alias("saved"))
    both = F.col("saved") + F.col("tokens")
    out = sums.withColumn("percent", F.when(both > 0, F.round(100 * F.col("saved") / both, 2)).otherwise(0.0))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("saved"), key)))  # one row a key


def prefix_cache(requests: DataFrame, key: str, read_discount: float, write_premium: float) -> DataFrame:
    """Row 112: tokens read from and written to the cache, requests that hit, and what that saves net of the premium."""
    hit = F.round(100 * F.count_if(F.col("cache_read") > 0) / F.count("*"), 2)
    out = requests.groupBy(key).agg(F.sum("cache_read").alias("read"), F.sum("cache_write").alias("written"), hit.alias("hit_percent"))
    return out.withColumn("net", F.round(F.col("read") * read_discount - F.col("written") * write_premium, 4))


def counters(requests: DataFrame, by: list[str], latency: str) -> DataFrame:
    """Rows 113, 119: requests and tokens, and the least, the greatest and the sum of the latency."""
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.sum("before").alias("tokens"), *(f(latency).alias(f"{n}_latency") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))))


def stage_overhead(requests: DataFrame, stages: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Row 117: statistics of each stage of a map of seconds, and the slowest stage of each request."""
    each = requests.select(key, F.explode(stages).alias("stage", "seconds"))
    stats = each.groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"), F.percentile("seconds", 0.95).alias("p95"))
    slowest = each.groupBy(key).agg(F.max_by(F.struct("stage", "seconds"), F.struct("seconds", "stage")).alias("s")).select(key, "s.stage", "s.seconds")
    return stats, slowest


def top_by(rows: DataFrame, value: Column, tie: str, most: int) -> DataFrame:
    """Row 172: the rows of the greatest value, what a report shows."""
    return rows.withColumn("value", value).orderBy(F.desc("value"), tie).limit(most)


def cache_stats(entries: DataFrame, by: list[str]) -> DataFrame:
    """Rows 139, 140: entries, bytes, hits and their share of lookups, evictions."""
    lookups = F.sum("hits") + F.sum("misses")
    rate = F.when(lookups > 0, F.sum("hits") / lookups).otherwise(0.0)
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.sum("hits").alias("hits"), F.round(rate, 6).alias("hit_rate"), F.count_if("evicted").alias("evictions"))


def reissued(calls: DataFrame, key: str, order: str, name: str, arguments: str, counted: Column) -> DataFrame:
    """Row 152: calls made before with the same name and arguments, but for those whose results are counted elsewhere."""
    w = Window.partitionBy(key, name, F.sha2(F.col(arguments).cast("string"), 256)).orderBy(order)
    return calls.withColumn("again", F.row_number().over(w) > 1).where(F.col("again") & ~F.coalesce(counted, F.lit(False))).drop("again")


def fast_skips(replies: DataFrame, key: str, order: str, words: Column, gap: Column, least: int, per_minute: float = 230.0, part: float = 0.3) -> DataFrame:
    """Rows 135, 168: by key the long responses, and those answered in less than a part of the time they take to read."""
    long = words >= least
    quick = long & (gap < part * words / per_minute * 60)
    return replies.groupBy(key).agg(F.count_if(F.coalesce(long, F.lit(False))).alias("long"), F.count_if(F.coalesce(quick, F.lit(False))).alias("skipped"))


def expansions(candidates: DataFrame, key: str, tie: str, age: Column, oldest: float, least: float, most: int) -> DataFrame:
    """Row 192: relevance less half of it at the greatest age, where enough is left; the best of each key."""
    scored = candidates.where(age <= oldest).withColumn("score", F.col("relevance") * (1 - 0.5 * age / oldest)).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), tie))).where(F.col("rank") <= most)


def ordered_union(*arrays: Column) -> Column:
    """Row 195: different values of several arrays in the order of their first place."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def by_content(*parts: DataFrame, content: str, rank: str) -> DataFrame:
    """Row 198: rows of several stores, one for each content: that of the least ``rank``."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hashed = every.withColumn("hash", F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16))
    return hashed.groupBy("hash").agg(F.min(F.struct(rank, *(c for c in every.columns if c != rank))).alias("r"), F.count("*").alias("copies")).select("hash", "copies", "r.*")


def stored(puts: DataFrame, gets: DataFrame, now: Column) -> DataFrame:
    """Row 355: entries by the hash of their content, the latest put of each alive or not, with how often they were fetched in time."""
    entry = puts.withColumn("hash", F.substring(F.sha2("content", 256), 1, 16)).groupBy("hash").agg(F.max("at").alias("at"), F.max_by("ttl", "at").alias("ttl"))
    fetched = gets.join(entry, "hash").where((F.col("got") >= F.col("at")) & (F.col("got") < F.col("at") + F.make_dt_interval(secs=F.col("ttl")))).groupBy("hash").agg(F.count("*").alias("fetched"))
    return entry.join(fetched, "hash", "left").select("hash", F.coalesce("fetched", F.lit(0).cast("long")).alias("fetched"), (F.col("at") + F.make_dt_interval(secs=F.col("ttl")) > now).alias("alive"))


def cleared(memories: DataFrame, scope: dict[str, object]) -> DataFrame:
    """Row 342: what is left when everything at or below a scope is deleted; levels that aren't named match all."""
    inside = F.lit(True)
    for c, v in scope.items():
        inside = inside & F.col(c).eqNullSafe(F.lit(v))
    return memories.where(~inside)


def detached(memories: DataFrame, key: str, by: str, back: str) -> DataFrame:
    """Row 341: links to a successor are kept only where the successor points back."""
    other = memories.select(F.col(key).alias("_next"), F.col(back).alias("_back"))
    joined = memories.join(other, F.col(by) == F.col("_next"), "left")
    return joined.withColumn(by, F.when(F.col("_back") == F.col(key), F.col(by))).drop("_next", "_back")


def window_contribution(rows: DataFrame, key: str, at: str, value: str, window: str) -> DataFrame:
    """Row 453: sums that begin anew with each window."""
    return rows.groupBy(key, F.window(at, window)["start"].alias("start")).agg(F.sum(value).alias("saved"))


def discrepancies(windows: DataFrame, surge: float = 15.0, alert: float = 30.0, digits: int = 2) -> DataFrame:
    """Row 137: use that is reported above what the tokens make of the limit."""
    expected = F.col("tokens") / F.col("limit") * 100
    delta = F.col("reported") - expected
    flagged = windows.where((F.col("limit") > 0) & (F.col("tokens") > 0)).withColumns({"expected": F.round(expected, digits), "delta": F.round(delta, digits), "severity": F.when(delta < alert, "warning").otherwise("alert")})
    return flagged.where(delta > surge)
