"""What the fields of arrays tell of them, and which numbers and odd items to keep (inventory rows 126, 182, 205, 209, 210, 212, 213, 215, 218, 219).

Arrays are long rows ``key, i, field, kind, value, number`` as in ``crush.long_items``; a field that an item lacks has no row,
one that is null has a null value.  Statistics are aggregates by (key, field); nothing collects an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds and milliseconds that are dates of this age.
EPOCHS = ((1e9, 2e9), (1e12, 2e12))
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: The share of an array that a strategy is expected to save.
SAVINGS = {"none": 0.0, "skip": 0.3, "time_series": 0.7, "cluster_sample": 0.8, "top_n": 0.6, "smart_sample": 0.5}


def presence(values: DataFrame) -> DataFrame:
    """``key, field, items, holding, common, rare``: fields of at least 80 % of an array's items, or of less than 20 %."""
    items = values.groupBy("key").agg(F.countDistinct("i").alias("items"))
    each = values.groupBy("key", "field").agg(F.count("*").alias("holding")).join(items, "key")
    return each.select("key", "field", "items", "holding", (F.col("holding") >= 0.8 * F.col("items")).alias("common"), (F.col("holding") < 0.2 * F.col("items")).alias("rare"))


def rare_kinds(values: DataFrame, most: int = 50, top: int = 5, share: float = 0.8) -> DataFrame:
    """Row 219 by array: ``key, field, value`` outside the fewest values that cover 80 %, of fields with 2 to 50 values and five such at most."""
    each = values.where("value IS NOT NULL").groupBy("key", "field", "value").agg(F.count("*").alias("n"))
    few = each.groupBy("key", "field").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where(F.col("kinds").between(2, most))
    order = Window.partitionBy("key", "field").orderBy(F.desc("n"), "value")
    ranked = each.join(few, ["key", "field"]).withColumns({"run": F.sum("n").over(order), "place": F.row_number().over(order)})
    needed = F.min(F.when(F.col("run") >= F.ceil(F.col("total") * share), F.col("place"))).over(Window.partitionBy("key", "field"))
    return ranked.withColumn("needed", needed).where((F.col("needed") <= top) & (F.col("place") > F.col("needed"))).select("key", "field", "value")


def structural_outliers(values: DataFrame) -> DataFrame:
    """Row 218: ``key, i`` of items with a rare field, or a rare value of a common one, in arrays of five items or more."""
    fields = presence(values).where("items >= 5")
    odd = values.join(fields.where("rare").select("key", "field"), ["key", "field"], "left_semi").select("key", "i")
    common = values.join(fields.where("common").select("key", "field"), ["key", "field"], "left_semi")
    return odd.union(common.join(rare_kinds(common), ["key", "field", "value"], "left_semi").select("key", "i")).distinct()


def information(values: DataFrame) -> DataFrame:
    """Row 182: ``key, i, score``: rare values 0.4, length 0.3, rare and missing fields 0.3; 0.5 for each part of an array of one.

    An item's length is that of its compact JSON text, escapes aside.
    """
    fields = presence(values)
    counts = values.groupBy("key", "field", "value").agg(F.count("*").alias("same")).withColumnsRenamed({"key": "k", "field": "f", "value": "v"})
    rows = values.join(fields, ["key", "field"]).join(counts, (F.col("key") == F.col("k")) & (F.col("field") == F.col("f")) & F.col("value").eqNullSafe(F.col("v")))
    text = F.coalesce("value", F.lit("null"))
    quoted = F.when((F.col("kind") == "string") & F.col("value").isNotNull(), 2).otherwise(0)
    items = rows.groupBy("key", "i").agg(
        F.max("items").alias("items"), F.avg(1 - F.col("same") / F.col("items")).alias("values"), (F.sum(F.length("field") + F.length(text) + quoted + 4) + 1).alias("length"),
        F.count_if("rare").alias("rares"), F.count_if("common").alias("commons"),
    )
    arrays = items.groupBy("key").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    kinds = fields.groupBy("key").agg(F.count_if("rare").alias("all_rare"), F.count_if("common").alias("all_common"))
    every = items.join(arrays, "key").join(kinds, "key")
    share = lambda n, of: F.when(F.col(of) > 0, n / F.col(of)).otherwise(0.0)
    one = F.col("items") < 2
    length = F.when(one | (F.col("low") == F.col("high")), 0.5).otherwise((F.col("length") - F.col("low")) / (F.col("high") - F.col("low")))
    structure = F.when(one, 0.5).otherwise(F.least(F.lit(1.0), 0.5 * share(F.col("rares"), "all_rare") + 0.5 * share(F.col("all_common") - F.col("commons"), "all_common")))
    return every.select("key", "i", F.round(0.4 * F.when(one, 0.5).otherwise(F.col("values")) + 0.3 * length + 0.3 * structure, 6).alias("score"))


def temporal(values: DataFrame) -> DataFrame:
    """Row 210: ``key, temporal``: most of a text field's first ten values are ISO dates, or a numeric field's least is an epoch."""
    first = Window.partitionBy("key", "field").orderBy("i")
    texts = values.where("kind = 'string' AND value IS NOT NULL").withColumn("_place", F.row_number().over(first)).where("_place <= 10")
    dated = texts.groupBy("key", "field").agg((F.avg(F.col("value").rlike(ISO).cast("double")) > 0.5).alias("hit"))
    low = F.min("number")
    clock = values.where("kind = 'numeric'").groupBy("key", "field").agg((low.between(*EPOCHS[0]) | low.between(*EPOCHS[1])).alias("hit"))
    every = dated.union(clock).groupBy("key").agg(F.bool_or("hit").alias("hit"))
    return values.select("key").distinct().join(every, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("temporal"))


def scores(values: DataFrame) -> DataFrame:
    """Row 215: ``key, field, confidence`` that a numeric field is a score: its bounds, how it descends, fractions among its first 20.

    A field whose sorted values step by about one is none.
    """
    order, ranked = Window.partitionBy("key", "field").orderBy("i"), Window.partitionBy("key", "field").orderBy("number")
    rows = values.where("kind = 'numeric' AND number IS NOT NULL").withColumns({"down": (F.lag("number").over(order) >= F.col("number")).cast("double"), "place": F.row_number().over(order), "step": F.col("number") - F.lag("number").over(ranked)})
    broken = F.when(F.col("place") <= 20, (F.col("number") != F.floor("number")).cast("double"))
    each = rows.groupBy("key", "field").agg(
        F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.avg("down").alias("down"), F.avg(broken).alias("broken"), F.avg("step").alias("step"), F.avg(F.col("step").between(0.5, 2).cast("double")).alias("even"),
    )
    bound = F.when((F.col("low") >= 0) & (F.col("high") <= 1), 0.4).when((F.col("low") >= 0) & (F.col("high") <= 10), 0.3).when((F.col("low") >= 0) & (F.col("high") <= 100), 0.25).when((F.col("low") >= -1) & (F.col("high") <= 1), 0.35)
    numbered = (F.col("n") >= 5) & F.col("step").between(0.5, 2) & (F.col("even") > 0.8)
    extra = F.when((F.col("n") >= 5) & (F.col("down") > 0.7), 0.3).otherwise(0.0) + F.when(F.col("broken") > 0.3, 0.1).otherwise(0.0)
    return each.select("key", "field", F.when(bound.isNull() | F.coalesce(numbered, F.lit(False)), 0.0).otherwise(F.round(F.least(bound + extra, F.lit(0.95)), 2)).alias("confidence"))


def patterns(values: DataFrame) -> DataFrame:
    """Row 209: ``key, pattern``: time_series, logs, search_results or generic, the first that applies."""
    text = F.coalesce("value", F.lit("None"))
    stats = values.groupBy("key", "field", "kind").agg(F.count("*").alias("n"), F.countDistinct(text).alias("kinds"), F.avg(F.length(text)).alias("length"), F.coalesce(F.var_samp("number"), F.lit(0.0)).alias("variance"))
    string, ratio = F.col("kind") == "string", F.col("kinds") / F.col("n")
    message = string & (ratio > 0.5) & (F.col("length") > 20)
    signs = stats.groupBy("key").agg(
        F.bool_or((F.col("kind") == "numeric") & (F.col("variance") > 0)).alias("varies"), F.bool_or(message).alias("messages"), F.bool_or(string & ~message & (ratio < 0.1) & F.col("kinds").between(2, 10)).alias("levels")
    )
    scored = scores(values).groupBy("key").agg(F.bool_or(F.col("confidence") >= 0.5).alias("scored"))
    every = signs.join(temporal(values), "key").join(scored, "key", "left")
    kind = F.when(F.col("temporal") & F.col("varies"), "time_series").when(F.col("messages") & F.col("levels"), "logs").when(F.col("scored"), "search_results").otherwise("generic")
    return every.select("key", kind.alias("pattern"))


def strategies(values: DataFrame, decisions: DataFrame, changing: DataFrame, least: int = 5) -> DataFrame:
    """Rows 212, 213: ``key, pattern, strategy, reduction``; ``decisions(key, crushable)``, ``changing(key)`` has change points.

    Reduction is the strategy's share and a fifth of the share of constant fields more, 0.95 at most.
    """
    text = F.coalesce("value", F.lit("None"))
    stats = values.groupBy("key", "field").agg(F.count("*").alias("n"), F.countDistinct(text).alias("kinds"))
    message = F.col("field").contains("message")
    named = F.min(F.when(message, F.struct("field", (F.col("kinds") / F.col("n")).alias("ratio"))))["ratio"]
    arrays = stats.groupBy("key").agg(F.avg((F.col("kinds") == 1).cast("double")).alias("constant"), named.alias("ratio"))
    every = patterns(values).join(arrays, "key").join(values.groupBy("key").agg(F.countDistinct("i").alias("items")), "key").join(decisions.select("key", "crushable"), "key", "left")
    every = every.join(changing.select("key").distinct().withColumn("changes", F.lit(True)), "key", "left")
    strategy = (
        F.when(F.col("items") < least, "none").when(~F.col("crushable"), "skip").when((F.col("pattern") == "time_series") & F.col("changes"), "time_series")
        .when((F.col("pattern") == "logs") & (F.col("ratio") < 0.5), "cluster_sample").when(F.col("pattern") == "search_results", "top_n").otherwise("smart_sample")
    )
    base = F.element_at(F.create_map(*(F.lit(x) for p in SAVINGS.items() for x in p)), F.col("strategy"))
    reduction = F.when(F.col("strategy") == "none", 0.0).otherwise(F.least(F.lit(0.95), base + 0.2 * F.col("constant")))
    return every.withColumn("strategy", strategy).select("key", "pattern", "strategy", F.round(reduction, 6).alias("reduction"))


def kept_numbers(numbers: DataFrame, keep: int, deviations: float = 2.0, window: int = 5) -> DataFrame:
    """Row 205: ``key, i, number, why`` of the numbers of ``key, i, number`` that stay.

    Arrays of eight or fewer whole; else those far from the mean, where the means of five before and five from it
    differ by as much, the first 30 % and last 15 % of ``keep``, and then evenly spread ones up to ``keep``.  Nulls and NaN are
    counted as places only.
    """
    w, own = Window.partitionBy("key").orderBy("i"), Window.partitionBy("key")
    finite = F.when(~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number"))
    rows = numbers.select("key", "i", "number", finite.alias("x")).withColumns({"p": F.row_number().over(w) - 1, "n": F.count("*").over(own), "mean": F.avg("x").over(own), "sd": F.coalesce(F.stddev_samp("x").over(own), F.lit(0.0))})
    rows = rows.withColumns({"left": F.avg("x").over(w.rowsBetween(-window, -1)), "right": F.avg("x").over(w.rowsBetween(0, window - 1))})
    first = min(keep, max(1, round(0.3 * keep)))
    last = min(keep - first, max(1, round(0.15 * keep)))
    far = (F.col("sd") > 0) & (F.abs(F.col("x") - F.col("mean")) > deviations * F.col("sd"))
    turn = (F.col("n") > 10) & (F.col("sd") > 0) & F.col("p").between(F.lit(window), F.col("n") - window - 1) & (F.abs(F.col("right") - F.col("left")) > deviations * F.col("sd"))
    why = F.when(F.col("n") <= 8, "whole").when(far, "far").when(turn, "turn").when((F.col("p") < first) | (F.col("p") >= F.col("n") - last), "edge")
    rows = rows.withColumn("why", why).withColumns({"kept": F.count("why").over(own), "outliers": F.count_if(F.col("why") == "far").over(own)})
    left = F.greatest(F.lit(0), keep - F.col("kept"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 1) / (left + 1))).cast("long")
    rows = rows.withColumn("spread", F.col("why").isNull() & (left > 0) & (F.pmod(F.col("p"), step) == 0)).withColumn("rank", F.count_if("spread").over(w))
    fill = F.col("spread") & (F.col("rank") <= keep + F.col("outliers") - F.col("kept"))
    return rows.where(F.col("why").isNotNull() | fill).select("key", "i", "number", F.coalesce("why", F.lit("spread")).alias("why"))


def number_summary(numbers: DataFrame) -> DataFrame:
    """Row 205: least, greatest, mean, median, deviation and quartiles (by linear interpolation) of each array's finite numbers."""
    rows = numbers.where(~F.isnan("number") & (F.abs("number") < float("inf")))
    at = lambda q, name: F.round(F.expr(f"percentile(number, {q})"), 6).alias(name)
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.round(F.avg("number"), 6).alias("mean"), at(0.5, "median"),
        F.round(F.coalesce(F.stddev_samp("number"), F.lit(0.0)), 6).alias("sd"), at(0.25, "p25"), at(0.75, "p75"),
    )


def distributions(rows: DataFrame, by: str, json: str) -> DataFrame:
    """Row 126: of each field of JSON objects by group: its type (mixed if several), and by type the mean length, share of different
    values, id look, negatives, integers, bucket of the population variance and whether values lie over two deviations out."""
    objects = rows.select(F.col(by).alias("by"), F.expr(f"try_parse_json({json})").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    each = rows.sparkSession.sql("SELECT o.by, e.key AS field, e.value AS v, schema_of_variant(e.value) AS type FROM {o} o, LATERAL variant_explode(o.v) e", o=objects)
    kind = F.when(F.col("type") == "STRING", "string").when(F.col("type") == "BOOLEAN", "boolean").when(F.col("type").startswith("ARRAY"), "array").when(F.col("type").startswith("OBJECT"), "object").when(F.col("type") == "VOID", "null").otherwise("numeric")
    each = each.select("by", "field", kind.alias("kind"), F.expr("try_variant_get(v, '$', 'string')").alias("s")).withColumn("x", F.when(F.col("kind") == "numeric", F.col("s").cast("double")))
    stats = each.groupBy("by", "field").agg(
        F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.avg(F.length("s")).alias("length"), (F.count_distinct("s") / F.count("s")).alias("uniqueness"),
        F.bool_or(F.col("x") < 0).alias("negative"), F.bool_and(F.col("x") == F.floor("x")).alias("whole"), F.var_pop("x").alias("variance"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    only = lambda k, c: F.when((F.col("kinds") == 1) & (F.col("kind") == k), c)
    bucket = F.when(F.col("variance") == 0, "zero").when(F.col("variance") < 10, "low").when(F.col("variance") < 1000, "medium").otherwise("high")
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) > 2 * F.sqrt("variance")
    return stats.select(
        F.col("by").alias(by), "field", "n", F.when(F.col("kinds") > 1, "mixed").otherwise(F.col("kind")).alias("type"), only("string", F.round("length", 6)).alias("mean_length"), only("string", F.round("uniqueness", 6)).alias("uniqueness"),
        only("string", (F.col("uniqueness") > 0.9) & (F.col("length") > 5)).alias("id_like"), only("numeric", F.col("negative")).alias("negative"), only("numeric", F.col("whole")).alias("whole"),
        only("numeric", F.when(F.col("n") > 1, bucket)).alias("spread"), only("numeric", (F.col("variance") > 0) & far).alias("outliers"),
    )
