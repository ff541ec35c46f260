"""Set and text similarity (inventory rows 196, 197, 268, 308, 309)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import ngrams, words

def jaccard(a: Column, b: Column) -> Column:
    """Row 197: of arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bag_f1(pairs: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Rows 196 and 309: F1 of the words that two texts share, with their counts."""
    side = lambda text, name: pairs.select(key, F.explode(words(text)).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))
    shared = side(left, "a").join(side(right, "b"), [key, "w"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))
    n = pairs.select(key, F.size(words(left)).alias("na"), F.size(words(right)).alias("nb"))
    s = F.coalesce("shared", F.lit(0))
    return n.join(shared, key, "left").select(key, F.when(F.col("na") + F.col("nb") == 0, F.lit(1.0)).otherwise(2.0 * s / (F.col("na") + F.col("nb"))).alias("f1"))


def echo_ratio(response: Column, context: Column, n: int = 8) -> Column:
    """Row 308: the share of a response's n-grams that its context has; 0 without any."""
    pair = F.array(F.struct(ngrams(words(response), n).alias("own"), ngrams(words(context), n).alias("other")))
    gone = F.transform(pair, lambda p: F.struct(p["own"].alias("own"), F.array_except(p["own"], p["other"]).alias("gone")))
    lost = lambda p: F.size(F.filter(p["own"], lambda g: F.array_contains(p["gone"], g)))
    return F.transform(gone, lambda p: F.when(F.size(p["own"]) == 0, F.lit(0.0)).when(F.size(p["gone"]) == 0, F.lit(1.0)).otherwise((F.size(p["own"]) - lost(p)) / F.size(p["own"])))[0]


def otsu(values: DataFrame, by: str, value: str) -> DataFrame:
    """Row 268: the cut between two neighbouring values that separates the classes best: the middle of them."""
    each = values.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    whole = Window.partitionBy(by)
    run = each.withColumns({"n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col(value)).over(w), "n1": F.sum("n").over(whole), "s1": F.sum(F.col("n") * F.col(value)).over(whole), "next": F.lead(value).over(w)})
    rest_n, rest_s = F.col("n1") - F.col("n0"), F.col("s1") - F.col("s0")
    spread = F.col("n0") * rest_n * F.pow(F.col("s0") / F.col("n0") - rest_s / rest_n, 2)
    cuts = run.where("next IS NOT NULL").withColumns({"spread": spread, "cut": (F.col(value) + F.col("next")) / 2})
    return cuts.groupBy(by).agg(F.max_by("cut", F.struct(F.round("spread", 6), -F.col("cut"))).alias("cut"))
