"""JSON arrays as rows: field statistics, outliers and what to keep (inventory rows 175, 178, 179, 183, 207, 215, 216, 219, 220, 285)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import has_error_word


def long_form(items: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """``key, i, field, value`` with values as text; an absent value is null."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.try_to_number(F.col(f).cast("string"), F.lit("S999999999999999.999999")).isNotNull().alias("numeric")) for f in fields))).alias("p")
    return items.select(key, F.col(order).alias("i"), pairs).select(key, "i", "p.*")


def field_stats(values: DataFrame, key: str) -> DataFrame:
    """Row 207: rows, different values (null is one), share of them, constancy and mean length of each field of each array."""
    text = F.coalesce("value", F.lit("None"))
    n = F.count("*")
    return values.groupBy(key, "field").agg(n.alias("n"), F.countDistinct(text).alias("distinct"), F.round(F.countDistinct(text) / n, 6).alias("uniqueness"), (F.countDistinct(text) == 1).alias("constant"), F.round(F.avg(F.length(text)), 6).alias("mean_length"))


def rare_values(items: DataFrame, field: str, most: int = 50, top: int = 5, share: float = 0.8) -> DataFrame:
    """Row 219: values outside the fewest that cover 80 %, where those are five at most and there are 2 to 50 in all."""
    each = items.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row a value, and no more than ``most`` of them matter
    w = every.orderBy(F.desc("n"), field)
    ranked = each.orderBy(F.desc("n"), field).limit(most + 1).withColumns({"run": F.sum("n").over(w), "place": F.row_number().over(w), "kinds": F.count("*").over(every), "total": F.sum("n").over(every)})
    needed = F.min(F.when(F.col("run") >= F.ceil(F.col("total") * share), F.col("place"))).over(every)
    return ranked.withColumn("needed", needed).where(F.col("kinds").between(2, most) & (F.col("needed") <= top) & (F.col("place") > F.col("needed"))).select(field, "n")


def item_hash(*fields: Column) -> Column:
    """Row 183: of an item's canonical text, null and absent apart."""
    return F.md5(F.to_json(F.struct(*(c.alias(f"f{i}") for i, c in enumerate(fields))), {"ignoreNullFields": "false"}))


def deduplicated(items: DataFrame, key: str, order: str, digest: Column) -> DataFrame:
    """Row 183: the first of equal items of an array."""
    w = Window.partitionBy(key, "_digest").orderBy(order)
    return items.withColumn("_digest", digest).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_digest", "_n")


def cluster_sample(items: DataFrame, key: str, order: str, message: Column, each: int = 2) -> DataFrame:
    """Row 175: two of each cluster of messages that begin alike."""
    w = Window.partitionBy(key, "cluster").orderBy(order)
    return items.withColumn("cluster", F.substring(F.md5(F.substring(message, 1, 50)), 1, 8)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")


def stride_fill(items: DataFrame, key: str, order: str, slots: int) -> DataFrame:
    """Row 178: up to ``slots`` different items spread over an array: every step-th from the first, then from the second."""
    w = Window.partitionBy(key).orderBy(order)
    placed = items.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key))})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / slots)).cast("int")
    placed = placed.withColumns({"_turn": F.col("_i") % step})
    first = Window.partitionBy(key).orderBy("_turn", "_i")
    return placed.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= slots).drop("_i", "_n", "_turn", "_rank")


def priority_keep(items: DataFrame, key: str, order: str, critical: Column, limit: int) -> DataFrame:
    """Row 179: every critical item, even beyond the limit, then the first three, the last two and the rest by place up to it."""
    own = Window.partitionBy(key)
    rows = items.withColumns({"_c": critical.cast("int"), "_f": F.row_number().over(own.orderBy(order)), "_b": F.row_number().over(own.orderBy(F.desc(order)))})
    rank = F.row_number().over(own.orderBy(F.desc("_c"), (F.col("_f") <= 3).cast("int").desc(), (F.col("_b") <= 2).cast("int").desc(), order))
    return rows.withColumn("_rank", rank).where((F.col("_c") == 1) | (F.col("_rank") <= limit)).drop("_c", "_f", "_b", "_rank")


def score_like(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Row 215: whether a field looks like a score: values within 0 and 100 that mostly descend."""
    w = Window.partitionBy(key).orderBy(order)
    down = (F.col(value) <= F.lag(value).over(w)).cast("double")
    return items.withColumn("down", down).groupBy(key).agg((F.min(value) >= 0).alias("positive"), (F.max(value) <= 100).alias("bounded"), F.round(F.avg("down"), 6).alias("descending")).withColumn("is_score", F.coalesce(F.col("positive") & F.col("bounded") & (F.col("descending") > 0.7), F.lit(False)))


def sequential(items: DataFrame, key: str, value: str) -> DataFrame:
    """Row 216: whether a field's sorted values mostly step by about one."""
    w = Window.partitionBy(key).orderBy(value)
    step = F.col(value) - F.lag(value).over(w)
    near = items.withColumn("step", step).groupBy(key).agg(F.count("*").alias("n"), F.avg("step").alias("mean"), F.avg(F.col("step").between(0.5, 2).cast("double")).alias("near"))
    return near.select(key, ((F.col("n") >= 5) & F.col("mean").between(0.5, 2) & (F.col("near") > 0.8)).alias("sequential"))


def errors(items: DataFrame, text: Column) -> DataFrame:
    """Row 220: items whose text names a failure."""
    return items.where(has_error_word(text))


def entropy(text: Column) -> Column:
    """Row 285: bits of the characters' distribution, as a share of that of as many different ones."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.when(n <= 1, F.lit(0.0)).otherwise(bits / F.log2(n))
