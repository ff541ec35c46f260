"""Windows over ordered rows (inventory rows 2, 84, 88, 131, 145-147, 151, 153, 154, 157-161, 163, 164, 167, 364)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_points(values: DataFrame, by: str, order: str, value: str, window: int = 5) -> DataFrame:
    """Row 145: places where the means of the values before and from it differ by over two deviations.

    Of candidates within ``window`` of each other the first stays, then the next one further on.
    """
    w = Window.partitionBy(by).orderBy(order)
    rows = values.select(by, order, F.col(value).alias("v")).withColumn("i", F.row_number().over(w) - 1)
    n, sd = F.count("*").over(Window.partitionBy(by)), F.stddev_samp("v").over(Window.partitionBy(by))
    rows = rows.withColumns({"n": n, "sd": sd, "before": F.avg("v").over(w.rowsBetween(-window, -1)), "after": F.avg("v").over(w.rowsBetween(0, window - 1))})
    hits = rows.where((F.col("i") >= window) & (F.col("i") < F.col("n") - window) & (F.col("sd") > 0) & (F.abs(F.col("after") - F.col("before")) > 2 * F.col("sd")))
    kept = F.aggregate(F.array_sort(F.collect_list("i")), F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > window), F.concat(acc, F.array(x))).otherwise(acc))
    return hits.groupBy(by).agg(kept.alias("places"))


def anomalies(values: DataFrame, by: str, value: str, deviations: float = 2.0) -> DataFrame:
    """Rows 146 and 147: rows further from their group's mean than so many sample deviations."""
    stats = values.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return values.join(stats, by).where((F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > deviations * F.col("sd"))).drop("mean", "sd")


def statistics(values: DataFrame, by: str, value: str) -> DataFrame:
    """Rows 148 and 149: mean, sample variance and deviation, median and quartiles between neighbours; null where a group has too few values."""
    quantile = lambda q, name: F.percentile(value, q).alias(name)
    return values.groupBy(by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"), quantile(0.5, "median"), quantile(0.25, "p25"), quantile(0.75, "p75"))


def bigram_curve(items: DataFrame, by: str, order: str, words: Column) -> DataFrame:
    """Row 153: after each item, how many different word pairs there have been; a single word counts as one."""
    from tokenloom.functions.text import ngrams

    pairs = items.select(by, order, F.explode_outer(F.when(F.size(words) == 1, words).otherwise(ngrams(words, 2))).alias("pair"))
    fresh = pairs.groupBy(by, "pair").agg(F.min(order).alias(order)).where("pair IS NOT NULL").groupBy(by, order).agg(F.count("*").alias("fresh"))
    w = Window.partitionBy(by).orderBy(order)
    return items.select(by, order).join(fresh, [by, order], "left").withColumn("seen", F.sum(F.coalesce("fresh", F.lit(0))).over(w)).drop("fresh")


def knee(curve: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Row 154: the place that lies furthest above the diagonal of the scaled curve, from 1; 1 for a flat one, null below 0.05."""
    w, own = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    rows = curve.select(by, F.col(value).alias("y"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(own).alias("n"), F.min(value).over(own).alias("low"), F.max(value).over(own).alias("high"))
    lift = (F.col("y") - F.col("low")) / (F.col("high") - F.col("low")) - F.col("i") / (F.col("n") - 1)
    top = rows.withColumn("lift", F.when(F.col("high") > F.col("low"), lift)).groupBy(by).agg(F.max(F.struct("lift", (-F.col("i")).alias("back"))).alias("m"), F.max(F.col("high") > F.col("low")).alias("rises"))
    return top.select(by, F.when(~F.col("rises"), F.lit(1)).when(F.col("m.lift") >= 0.05, -F.col("m.back") + 1).cast("long").alias("knee"))


def frozen_prefix(messages: DataFrame, by: str, order: str, tokens: str, cached: Column) -> DataFrame:
    """Row 157: how many leading messages fit into the cached tokens."""
    w = Window.partitionBy(by).orderBy(order)
    return messages.withColumn("sum", F.sum(tokens).over(w)).groupBy(by).agg(F.count_if(F.col("sum") <= cached).alias("frozen"))


def suffix_tokens(messages: DataFrame, by: str, order: str, tokens: str) -> DataFrame:
    """Row 159: tokens after each message."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return messages.withColumn("suffix", F.coalesce(F.sum(tokens).over(w), F.lit(0)).cast("long"))


def cache_misses(requests: DataFrame, by: str, ttl_seconds: int) -> DataFrame:
    """Row 158: why a request read nothing from the cache, against the one before it.

    Columns: ts, id, cached (tokens read), prefix (hash).  A lapsed time to live wins over a changed prefix.
    """
    w = Window.partitionBy(by).orderBy("ts", "id")
    idle = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    kind = F.when(F.lag("ts").over(w).isNull(), "cold_start").when(F.col("cached") > 0, "hit").when(idle > ttl_seconds * 1_000_000, "ttl_expiry").when(F.lag("prefix").over(w) != F.col("prefix"), "prefix_change").otherwise("unknown")
    return requests.withColumn("cause", kind)


def around(lines: DataFrame, by: str, order: str, hit: Column, before: int, after: int) -> DataFrame:
    """Rows 160 and 164: the lines so close to a hit."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-after, before)
    return lines.withColumn("near", F.max(hit.cast("int")).over(w) == 1).where("near").drop("near")


def first_last_best(rows: DataFrame, by: str, order: str, score: str, limit: int) -> DataFrame:
    """Rows 161 and 163: the first, the last, then the best of a group up to ``limit``; ties by place."""
    w = Window.partitionBy(by)
    ends = rows.withColumn("end", (F.row_number().over(w.orderBy(order)) == 1) | (F.row_number().over(w.orderBy(F.desc(order))) == 1))
    return ends.withColumn("rank", F.row_number().over(w.orderBy(F.desc("end"), F.desc(score), order))).where(F.col("rank") <= limit).drop("end", "rank")


def recoveries(calls: DataFrame, reach: int = 5) -> DataFrame:
    """Row 84: for a success the last error of the same tool at most ``reach`` calls before it.

    Columns: session, tool, seq, is_error.
    """
    w = Window.partitionBy("session", "tool").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = calls.withColumn("error_seq", F.last(F.when(F.col("is_error"), F.col("seq")), ignorenulls=True).over(w))
    return seen.where(~F.col("is_error") & (F.col("seq") - F.col("error_seq") <= reach)).select("session", "tool", "seq", "error_seq")


def read_lifecycle(operations: DataFrame) -> DataFrame:
    """Row 88: reads that a later edit of the path made stale, or a later wider read superseded; staleness wins.

    Columns: session, path, seq, kind (read or edit), low, high (the range read).
    """
    later = Window.partitionBy("session", "path").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    edited = F.max((F.col("kind") == "edit").cast("int")).over(later)
    reads = operations.withColumns({"edited": edited, "later": F.collect_list(F.when(F.col("kind") == "read", F.struct("low", "high"))).over(later)})
    covered = F.exists("later", lambda r: (r["low"] <= F.col("low")) & (r["high"] >= F.col("high")))
    return reads.where("kind = 'read'").select("session", "path", "seq", F.when(F.col("edited") == 1, "stale").when(covered, "superseded").otherwise("fresh").alias("state"))


def rereads(results: DataFrame, least_tokens: int = 50, gap: int = 3) -> DataFrame:
    """Rows 2 and 151: tokens of contents served again after over ``gap`` messages; nearer repeats are polling.

    Columns: conv_id, turn, hash, tokens.
    """
    w = Window.partitionBy("conv_id", "hash").orderBy("turn")
    once = results.groupBy("conv_id", "turn", "hash").agg(F.max("tokens").alias("tokens"))
    again = once.withColumn("since", F.col("turn") - F.lag("turn").over(w)).where((F.col("since") > gap) & (F.col("tokens") >= least_tokens))
    return again.groupBy("conv_id").agg(F.count("*").alias("rereads"), F.sum("tokens").alias("tokens"))


def loops(calls: DataFrame, least: int) -> DataFrame:
    """Row 131: calls with one signature that a session repeats; all of an error loop is wasted, else all but the largest.

    Columns: session, signature, is_error, bytes.
    """
    each = calls.groupBy("session", "signature").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).where(F.col("n") >= least)
    failing = F.col("errors") >= F.col("n") / 2
    return each.groupBy("signature").agg(F.count("*").alias("sessions"), F.sum("n").alias("calls"), F.sum(F.when(failing, F.col("bytes")).otherwise(F.col("bytes") - F.col("largest"))).alias("wasted"))


def drift(requests: DataFrame, by: str, order: str, *axes: str) -> DataFrame:
    """Row 364: which hashes differ from those of the request before."""
    w = Window.partitionBy(by).orderBy(order)
    return requests.withColumns({f"{a}_changed": F.coalesce(F.col(a) != F.lag(a).over(w), F.lit(False)) for a in axes})


def gaps(events: DataFrame, by: str, order: str, limits: dict[str, int]) -> DataFrame:
    """Row 167: pauses between events by length, in seconds."""
    w = Window.partitionBy(by).orderBy(order)
    pause = (F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(F.lag(order).over(w).cast("timestamp"))) / 1e6
    return events.withColumn("pause", pause).groupBy(by).agg(F.round(F.expr("percentile(pause, 0.5)"), 6).alias("median_pause"), *(F.count_if(F.col("pause") > s).alias(n) for n, s in limits.items()))
