"""What kind of array it is, whether sampling it is safe, and which items to keep (inventory rows 146, 174, 176, 179, 193, 203, 207, 208, 211, 214, 220, 229, 318).

Arrays are rows ``key, i`` with a column a field.  All statistics of all fields come from one long
table, aggregated by (key, field); nothing collects an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import UUID, has_error_word
from tokenloom.operators.sequences import change_points


def long_items(items: DataFrame, key: str, order: str, numeric: list[str], text: list[str]) -> DataFrame:
    """``key, i, field, kind, value, number``."""
    number = lambda f, c: F.struct(F.lit(f).alias("field"), F.lit("numeric").alias("kind"), F.col(f).cast("string").alias("value"), c.alias("number"))
    string = lambda f: F.struct(F.lit(f).alias("field"), F.lit("string").alias("kind"), F.col(f).alias("value"), F.lit(None).cast("double").alias("number"))
    each = F.explode(F.array(*(number(f, F.col(f).cast("double")) for f in numeric), *(string(f) for f in text))).alias("p")
    return items.select(F.col(key).alias("key"), F.col(order).alias("i"), each).select("key", "i", "p.*")


def profiles(values: DataFrame) -> DataFrame:
    """Rows 207, 214: of each field of each array its share of different values, length, spread, and whether it looks like an id."""
    text = F.coalesce("value", F.lit("None"))
    n = F.count("*")
    stats = values.groupBy("key", "field", "kind").agg(
        n.alias("n"), F.countDistinct(text).alias("different"), (F.countDistinct(text) / n).alias("uniqueness"), F.avg(F.length(text)).alias("length"),
        F.coalesce(F.var_samp("number"), F.lit(0.0)).alias("variance"), F.avg("number").alias("mean"), F.min("number").alias("low"), F.max("number").alias("high"), F.avg(text.rlike(f"^{UUID}$").cast("double")).alias("uuids"),
    )
    steps = (F.col("high") - F.col("low")) / F.greatest(F.col("n") - 1, F.lit(1))
    confidence = F.when(F.col("uniqueness") < 0.9, 0.0).when(F.col("uuids") > 0.8, 0.95).when((F.col("kind") == "numeric") & (F.col("n") >= 5) & steps.between(0.5, 2), 0.9).when(F.col("uniqueness") > 0.98, 0.7).otherwise(0.0)
    return stats.withColumn("id_confidence", confidence)


def signals(values: DataFrame, stats: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Rows 146, 220: of each item whether a number of it is far out or its text names a failure."""
    joined = values.join(stats.select("key", "field", "mean", "variance"), ["key", "field"])
    far = (F.col("variance") > 0) & (F.abs(F.col("number") - F.col("mean")) > deviations * F.sqrt("variance"))
    return joined.groupBy("key", "i").agg(F.coalesce(F.bool_or(far), F.lit(False)).alias("far"), F.bool_or((F.col("kind") == "string") & has_error_word(F.col("value"))).alias("failing"))


def decide(stats: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows 208, 211: ``key, n, crushable, reason`` by how different the items are and whether anything tells some apart."""
    best = F.max(F.struct(F.col("id_confidence").alias("c"), F.col("uniqueness").alias("u"), F.col("field").alias("f")))
    ids = stats.groupBy("key").agg(best.alias("id"))
    rest = stats.join(ids, "key").where((F.col("field") != F.col("id.f")) | (F.col("id.c") < 0.7))
    mean = lambda kind, name: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("uniqueness"))), F.lit(0.0)).alias(name)
    content = rest.groupBy("key").agg(mean("string", "strings"), mean("numeric", "numbers"))
    seen = marks.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(F.col("far") | F.col("failing")).alias("signal"))
    every = seen.join(ids, "key").join(content, "key", "left").fillna(0.0, ["strings", "numbers"])
    has_id = F.col("id.c") >= 0.7
    most = F.greatest("strings", F.when(has_id, F.col("id.u")).otherwise(0.0))
    reason = (
        F.when(has_id & (F.greatest("strings", "numbers") < 0.1), "repeats_with_ids").when(most < 0.3, "repeats").when(has_id & (most > 0.8) & ~F.col("signal"), "entities")
        .when((most > 0.8) & F.col("signal"), "entities_with_signal").when(~F.col("signal"), "mixed").otherwise("mixed_with_signal")
    )
    return every.select("key", "n", reason.alias("reason")).withColumn("crushable", ~F.col("reason").isin("entities", "mixed"))


def kept(values: DataFrame, marks: DataFrame, decisions: DataFrame, limit: int, trend: str | None = None) -> DataFrame:
    """Rows 174, 176, 179, 193, 203: ``key, i, why`` of the items that stay: all where sampling isn't safe or needed, else what is marked,
    the first three and last two, neighbours of a change in ``trend``, and by place up to ``limit``."""
    every = Window.partitionBy("key")
    rows = marks.join(decisions, "key").withColumns({"first": F.row_number().over(every.orderBy("i")), "back": F.row_number().over(every.orderBy(F.desc("i")))})
    if trend is not None:
        places = change_points(values.where(F.col("field") == trend), "key", "i", "number").select("key", F.explode("places").alias("at"))
        near = places.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + 2)).alias("first")).distinct().withColumn("turns", F.lit(True))
        rows = rows.join(near, ["key", "first"], "left")
    else:
        rows = rows.withColumn("turns", F.lit(None).cast("boolean"))
    why = (
        F.when(~F.col("crushable") | (F.col("n") <= limit), "whole").when(F.col("failing"), "failing").when(F.col("far"), "far").when(F.col("turns"), "turns").when((F.col("first") <= 3) | (F.col("back") <= 2), "edge").otherwise("rest")
    )
    ranked = rows.withColumn("why", why).withColumn("rank", F.row_number().over(every.orderBy((F.col("why") == "rest").cast("int"), "first")))
    return ranked.where((F.col("why") != "rest") | (F.col("rank") <= limit)).select("key", "i", "why")


def offloaded(decisions: DataFrame, keeps: DataFrame) -> DataFrame:
    """Rows 203, 229: how many items of each array went to the store."""
    left = keeps.groupBy("key").agg(F.count("*").alias("kept"))
    return decisions.join(left, "key", "left").select("key", "reason", "n", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("offloaded"))


def marker(digest: Column, count: Column) -> Column:
    """Rows 203, 318: what stands for offloaded rows."""
    return F.concat(F.lit("<<ccr:"), digest, F.lit(" "), count.cast("string"), F.lit("_rows_offloaded>>"))
