"""Bitemporal memories, caches and graphs (inventory rows 35, 79, 80, 94, 166, 169, 189-191, 333, 334, 336, 337, 340, 360)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.numbers import decayed


def scoped(memories: DataFrame, user: object = None, session: object = None, at=None, least: float | None = None, current: bool = True, entities: list[str] | None = None) -> DataFrame:
    """Row 35: by scope, validity at a time (half open; else the open ones), importance, any of some entities."""
    out = memories
    for name, value in (("user_id", user), ("session_id", session)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if at is not None:
        out = out.where((F.col("valid_from") <= F.lit(at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(at))))
    elif current:
        out = out.where("valid_until IS NULL")
    if least is not None:
        out = out.where(F.col("importance") >= least)
    if entities is not None:
        out = out.where(F.arrays_overlap("entity_refs", F.lit(entities)))
    return out


def superseded(versions: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Row 340: each version is valid until the next one of its key begins, and names it."""
    w = Window.partitionBy(key).orderBy(start, tie)
    return versions.withColumns({"valid_from": F.col(start), "valid_until": F.lead(start).over(w), "superseded_by": F.lead(tie).over(w)})


def history(versions: DataFrame, wanted: DataFrame, depth: int = 100) -> DataFrame:
    """Row 169: the chain of versions back from each wanted one, ``id, version, step``.

    Walks one link a round until no row has one left, ``depth`` rounds at most against cycles.
    """
    links = versions.select(F.col("id").alias("version"), F.col("supersedes").alias("next"))
    level = wanted.select("id", F.col("id").alias("version")).join(links, "version").withColumn("step", F.lit(0))
    out = [level]
    for step in range(1, depth + 1):
        level = level.where("next IS NOT NULL").select("id", F.col("next").alias("version")).join(links, "version").withColumn("step", F.lit(step)).persist()
        if not level.limit(1).count():
            break
        out.append(level)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select("id", "version", "step")


def decayed_rank(memories: DataFrame, now: Column, k: int, least: float = 0.05) -> DataFrame:
    """Rows 166 and 189: the k most important of a user after decay; ties by id."""
    value = decayed(F.col("importance"), F.datediff(now, F.col("created_at")).cast("double"), F.col("accesses"))
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "id")
    return memories.withColumn("value", F.round(value, 6)).where(F.col("value") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_bytes(entries: DataFrame, by: str, newest: list[Column], size: str, bound: int) -> DataFrame:
    """Rows 190 and 191: from the newest on, what stays within a number of bytes."""
    w = Window.partitionBy(by).orderBy(*newest)
    return entries.withColumn("sum", F.sum(size).over(w)).where(F.col("sum") <= bound).drop("sum")


def resolve(markers: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """Rows 79 and 80: what hashes in texts stand for: found, expired or missing.

    ``markers(doc_id, hash)``, ``store(hash, content, created_at, ttl)`` in seconds.
    """
    live = F.col("created_at") + F.make_interval(secs=F.col("ttl").cast("decimal(18,6)")) > now
    joined = markers.join(store, "hash", "left")
    return joined.select("doc_id", "hash", F.when(F.col("created_at").isNull(), "missing").when(live, "found").otherwise("expired").alias("status"), F.when(live, F.col("content")).alias("content"))


def learned_ttl(observations: DataFrame) -> DataFrame:
    """Row 360: the longest pause that still hit and the shortest that missed, by provider and model."""
    return observations.groupBy("provider", "model").agg(F.max(F.when(F.col("hit"), F.col("idle"))).alias("at_least"), F.min(F.when(~F.col("hit"), F.col("idle"))).alias("below"))


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Row 334: ``id, hops`` of every node reached from ``start(id)`` along ``edges(a, b)`` in either direction, the fewest hops.

    A round joins the newest nodes only; those seen are left out by an anti join.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    seen = start.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = both.join(front, both["a"] == front["id"]).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.union(front)
    return seen


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows 333 and 334: the relations of the nodes, whether or not their other end is among them."""
    return edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").union(edges.join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select(*edges.columns)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Row 337."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def without_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Row 336: removing nodes removes their edges."""
    for end in "ab":
        edges = edges.join(removed.select(F.col("id").alias(end)), end, "left_anti")
    return edges.select("a", "b")


def difference(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Row 94: what either side lacks."""
    one = ours.select(key).distinct().join(theirs.select(key), key, "left_anti").withColumn("side", F.lit("export"))
    return one.union(theirs.select(key).distinct().join(ours.select(key), key, "left_anti").withColumn("side", F.lit("import")))
