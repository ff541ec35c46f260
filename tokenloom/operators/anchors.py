"""Items of an array that stay because of where they stand or what a query names (inventory rows 181, 222, 223).

Arrays are rows ``key, i, value`` with a ``score``; ``i`` orders an array.  Slots are at most twelve an array, so what is gathered for an array are
some candidates of each slot; a fold over them keeps contents apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the share of what may stay that is for anchors, slots at least and at most, weights of front, middle and back, and what a query's words move
SHARE, SLOTS = 0.25, (3, 12)
WEIGHTS = {"search_results": (0.75, 0.1, 0.15), "logs": (0.15, 0.1, 0.75), "time_series": (0.45, 0.1, 0.45), "generic": (0.5, 0.1, 0.4)}
RECENT = ("latest", "recent", "last", "newest", "current", "now")
EARLY = ("first", "oldest", "earliest", "original", "initial", "beginning")
MOVE, LOW, HIGH = 0.15, 0.1, 0.8
#: Candidates of a slot in the middle, and places tried beside one at the ends.
CANDIDATES, BESIDE = 3, (0, 1, -1, 2, -2)
# fixed values: what of a query names something
NAMES = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b\d{4,}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
)
HOST, QUOTED = r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z]{2,})?\b", r"['\"]([^'\"]{1,50})['\"]"
NO_HOST = ("e.g", "i.e", "etc.")


def weights(pattern: Column, query: Column) -> Column:
    """Front, middle and back, of 1 together."""
    said = lambda names: reduce(Column.__or__, [F.contains(F.lower(F.coalesce(query, F.lit(""))), F.lit(x)) for x in names])
    base = lambda k: reduce(lambda rest, p: F.when(pattern == p, WEIGHTS[p][k]).otherwise(rest), [p for p in WEIGHTS if p != "generic"], F.lit(WEIGHTS["generic"][k]))
    front, middle, back = (base(k) for k in range(3))
    later, earlier = said(RECENT) & ~said(EARLY), said(EARLY) & ~said(RECENT)
    less, more = (lambda x: F.greatest(F.lit(LOW), x - MOVE)), (lambda x: F.least(F.lit(HIGH), x + MOVE))
    front, back = F.when(later, less(front)).when(earlier, more(front)).otherwise(front), F.when(later, more(back)).when(earlier, less(back)).otherwise(back)
    total = front + middle + back
    return F.struct((front / total).alias("front"), (middle / total).alias("middle"), (back / total).alias("back"))


def slots(n: Column, most: int, weight: Column) -> Column:
    """How many anchors an array of more than ``most`` items has at the front, in the middle and at the back."""
    budget = F.least(n, F.lit(min(SLOTS[1], max(SLOTS[0], int(most * SHARE)))))
    part = lambda w: F.greatest(F.lit(1), F.floor(F.round(budget * w, 9)).cast("int"))
    front, back = part(weight["front"]), part(weight["back"])
    return F.struct(front.alias("front"), F.greatest(F.lit(0), budget - front - back).alias("middle"), F.greatest(F.lit(1), back - F.greatest(F.lit(0), front + back - budget)).alias("back"))


def _spread(low: Column, high: Column, count: Column) -> Column:
    """``count`` places at even steps inside low to high - 1, all of them where there are no more."""
    size = high - low
    at = lambda i: F.least(high - 1, low + F.floor(F.round((i + 1) * size / (count + 1), 9)).cast("int"))
    whole = count >= size
    return F.when((count < 1) | (size < 1), F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.least(count, size) - 1), lambda i: F.when(whole, low + i).otherwise(at(i))))


def _taken(candidates: Column, seen: Column, most: Column) -> Column:
    """Places and contents taken in order: of a slot one, of a content one, ``most`` in all."""
    start = F.struct(F.array().cast("array<int>").alias("at"), seen.alias("seen"), F.lit(-1).alias("slot"))

    def step(state: Column, c: Column) -> Column:
        fits = (c["slot"] != state["slot"]) & ~F.array_contains(state["seen"], c["h"]) & (F.size(state["at"]) < most)
        return F.struct(F.when(fits, F.concat(state["at"], F.array(c["p"]))).otherwise(state["at"]).alias("at"), F.when(fits, F.concat(state["seen"], F.array(c["h"]))).otherwise(state["seen"]).alias("seen"), F.when(fits, c["slot"]).otherwise(state["slot"]).alias("slot"))

    return F.aggregate(candidates, start, step)


def anchors(items: DataFrame, arrays: DataFrame, most: int) -> DataFrame:
    """Row 181: ``key, i`` of items that anchor their array, all of one with ``most`` items or fewer.

    ``items(key, i, value, score)``; ``arrays(key, pattern, query)`` says what an array is (null or missing: generic).  Front and back places are spread over twice
    their slots, in the outer thirds; one whose content is taken already gives way to a neighbour.  The middle takes the best scored of three
    candidates a slot, ties by place.  No content is taken twice.
    """
    w = Window.partitionBy("key")
    placed = items.select("key", "i", F.coalesce("score", F.lit(0.5)).alias("score"), F.sha2(F.coalesce("value", F.lit("")), 256).alias("h"), F.col("value").isNull().alias("null")).withColumns({"p": F.row_number().over(w.orderBy("i")) - 1, "h": F.when(F.col("null"), "").otherwise(F.col("h"))})
    sizes = placed.groupBy("key").agg(F.count("*").cast("int").alias("n"))
    told = sizes.join(arrays.select("key", "pattern", "query").dropDuplicates(["key"]), "key", "left")
    large = told.where(F.col("n") > most).withColumn("s", slots(F.col("n"), most, weights(F.col("pattern"), F.col("query")))).select("key", "n", "s")
    third, n = F.floor(F.col("n") / 3).cast("int"), F.col("n")
    front_end, back_start = F.least(F.col("s.front") * 2, third), F.greatest(n - F.col("s.back") * 2, F.floor(2 * n / 3).cast("int"))
    ends = F.concat(
        F.transform(_spread(F.lit(0), front_end, F.col("s.front")), lambda p, i: F.struct(i.alias("slot"), p.alias("at"), F.lit(0).alias("low"), front_end.alias("high"), (F.col("s.front") >= front_end).alias("all"))),
        F.transform(_spread(back_start, n, F.col("s.back")), lambda p, i: F.struct((i + 100).alias("slot"), p.alias("at"), back_start.alias("low"), n.alias("high"), (F.col("s.back") >= n - back_start).alias("all"))),
    )
    slot = large.select("key", F.explode(ends).alias("e"))
    tried = slot.select("key", "e.*", F.posexplode(F.array(*[F.lit(x) for x in BESIDE])).alias("try", "beside")).withColumn("p", F.col("at") + F.col("beside")).where((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high")) & (~F.col("all") | (F.col("beside") == 0)))
    gather = lambda rows, *order: rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*order, "slot", "p", "h"))).alias("c"))
    found = gather(tried.join(placed.select("key", "p", "h"), ["key", "p"]), F.col("slot").alias("o1"), F.col("try").alias("o2"))
    outer = large.join(found, "key", "left").withColumn("c", F.coalesce("c", F.array().cast(found.schema["c"].dataType)))
    outer = outer.withColumn("t", _taken(F.col("c"), F.array().cast("array<string>"), F.lit(SLOTS[1]))).select("key", "n", "s", "t.at", "t.seen")
    in_front = F.size(F.filter("at", lambda p: p < F.least(F.col("s.front") * 2, third)))
    middle = outer.withColumns({"low": in_front, "high": n - (F.size("at") - in_front)})
    size = F.least(F.col("s.middle") * CANDIDATES, F.col("high") - F.col("low"))
    asked = middle.select("key", F.posexplode(_spread(F.col("low"), F.col("high"), size)).alias("slot", "p")).join(placed.select("key", "p", "h", "score"), ["key", "p"])
    inner = gather(asked, (-F.col("score")).alias("o1"), F.col("slot").alias("o2"))
    # candidates that the ends have taken don't count
    both = outer.join(inner, "key", "left").withColumn("c", F.coalesce(F.filter("c", lambda c: ~F.array_contains(F.col("seen"), c["h"])), F.array().cast(inner.schema["c"].dataType)))
    both = both.withColumn("c", F.slice("c", F.lit(1), F.greatest(F.lit(0), F.col("s.middle"))))
    both = both.withColumn("m", _taken(F.col("c"), F.col("seen"), F.lit(SLOTS[1]))["at"])
    kept = both.select("key", F.explode(F.concat("at", "m")).alias("p")).distinct().join(placed.select("key", "p", "i"), ["key", "p"]).select("key", "i")
    return kept.union(placed.join(sizes.where(F.col("n") <= most).select("key"), "key", "left_semi").select("key", "i"))


def query_anchors(query: Column) -> Column:
    """Row 222: the ids, numbers of four digits, hosts, quoted strings and addresses that a query names, lower-cased."""
    every = lambda pattern, k=0: F.transform(F.regexp_extract_all(query, F.lit(pattern), F.lit(k)), F.lower)
    hosts = F.filter(every(HOST), lambda x: ~x.isin(*NO_HOST))
    quoted = F.filter(every(QUOTED, 1), lambda x: F.octet_length(F.trim(x)) >= 2)
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*[every(p) for p in NAMES], hosts, quoted))), F.array().cast("array<string>"))


def names_any(value: Column, names: Column) -> Column:
    """Row 222: whether an item's text holds one of the names."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.exists(names, lambda a: F.contains(low, a))


def preserved(fields: DataFrame, hashes: list[str], query: Column) -> DataFrame:
    """Row 223: ``key, i`` of items with a field, told by the first eight digits of its name's SHA-256, whose value holds the query or is held by it.

    ``fields(key, i, field, value)`` of items; null values and empty queries match nothing.
    """
    low, asked = F.lower("value"), F.lower(query)
    met = F.substring(F.sha2("field", 256), 1, 8).isin(*hashes) & (asked != "") & (F.contains(low, asked) | F.contains(asked, low))
    return fields.where(met).select("key", "i").distinct()


def with_forced(kept: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """Row 222: ``key, i, forced`` of anchors and of items that name what ``names(key, names)`` asks for; these come on top of the slots."""
    forced = items.join(names, "key").where(names_any(F.col("value"), F.col("names"))).select("key", "i", F.lit(True).alias("forced"))
    return kept.withColumn("forced", F.lit(False)).unionByName(forced).groupBy("key", "i").agg(F.max("forced").alias("forced"))
