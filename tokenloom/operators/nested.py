"""Nested JSON cut down to what matters, by path (inventory rows 200, 202, 204, 206).

Values are rows: a document's arrays and objects are opened level by level, arrays long enough are cut by kind, and what stays is put together
again from the deepest level up.  Windows and groups are those of one array or object.  How many items stay is a parameter; items that
name a failure stay in any case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.cluster import shared_folder
from tokenloom.functions.numbers import k_split
from tokenloom.functions.text import has_error_word
from tokenloom.operators.crush import marker
from tokenloom.operators.tables import json_string, exploded_fields, type_tag

#: Up to so many items or keys nothing goes; arrays and groups of fewer items aren't looked into; deviations of an outlier;
#: tokens of an object that is cut and of an entry that always stays.
WHOLE, LEAST, FAR, LEAST_TOKENS, SMALL = 8, 5, 2.0, 200, 12
#: Fixed value: largest whole number times count up to which deviations are compared exactly, in 38 digits.
EXACT = 1e12


def _edges(k: int) -> tuple[Column, Column]:
    front, back, _ = k_split(F.lit(k))
    front = F.least(front, F.lit(k))
    return front, F.least(back, F.lit(k) - front)


def _far(value: Column, w) -> Column:
    """Further than two sample deviations from the window's mean; false where there is none.

    Whole numbers are compared exactly, so that one at just two deviations isn't far, whatever the order of rows; others, and those whose largest times their
    count is over ``EXACT``, as doubles.
    """
    n, x = F.count(value).over(w), value.try_cast("decimal(13,0)")
    total, squares, most = F.sum(x).over(w), F.sum((x * x).cast("decimal(26,0)")).over(w), F.max(F.abs(value)).over(w)
    whole = F.bool_and(value == x.cast("double")).over(w) & (most * n <= EXACT)
    big = lambda c, digits=26: c.try_cast(f"decimal({digits},0)")
    # with d = n * value - total, a deviation is the root of (n * squares - total * total) / (n * (n - 1)) and the value d / n from the mean
    d = big(big(n, 13) * x - total, 13)
    apart, spread = big(d * d) * big(n - 1, 12), big(big(n, 13) * big(squares, 25), 38) - big(big(total, 13) * big(total, 13))
    exact = apart > int(FAR * FAR) * big(n, 11) * big(spread)
    double = (F.stddev_samp(value).over(w) > 0) & (F.abs(value - F.avg(value).over(w)) > FAR * F.stddev_samp(value).over(w))
    return F.coalesce(F.when(whole, exact).otherwise(double), F.lit(False))


def kept_strings(items: DataFrame, k: int, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Row 204: ``items(key, i, value)`` that stay, ``value`` never null.

    All of eight at most; else those that name a failure or are of an odd length, the first and last of ``k``, and from there up to ``k`` at even
    strides, each text once.  Failures and odd ones don't count against these.
    """
    w = Window.partitionBy(*by)
    front, back = _edges(k)
    failing, odd = has_error_word(F.col("value")), _far(F.length("value").cast("double"), w)
    rows = items.withColumns({"_p": F.row_number().over(w.orderBy("i")) - 1, "_n": F.count("*").over(w), "_failing": failing, "_odd": odd})
    rows = rows.withColumn("_keep", F.col("_failing") | F.col("_odd") | (F.col("_p") < front) | (F.col("_p") >= F.col("_n") - back))
    total = lambda c: F.sum(F.col(c).cast("int")).over(w)
    rows = rows.withColumns({"_kept": total("_keep"), "_cap": k + total("_failing") + total("_odd"), "_seen": F.max("_keep").over(Window.partitionBy(*by, "value"))})
    budget = F.greatest(F.lit(0), k - F.col("_kept"))
    stride = F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / (budget + 1)).cast("int"))
    rows = rows.withColumn("_asked", (budget > 0) & ~F.col("_keep") & ~F.col("_seen") & (F.col("_p") % stride == 0))
    rows = rows.withColumn("_new", F.col("_asked") & (F.row_number().over(Window.partitionBy(*by, "value", "_asked").orderBy("_p")) == 1))
    rows = rows.withColumn("_turn", F.sum(F.col("_new").cast("int")).over(w.orderBy("_p")))
    stays = (F.col("_n") <= WHOLE) | F.col("_keep") | (F.col("_new") & (F.col("_turn") <= F.col("_cap") - F.col("_kept")))
    return rows.where(stays).select(*items.columns)


def kept_keys(entries: DataFrame, k: int, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Row 206: ``entries(key, i, name, json)`` of objects that stay.

    All of eight entries at most, of objects under ``least_tokens``, and where ``k`` covers all; else those whose value names a failure or that are small, the first and
    last of ``k``, and from there up to ``k`` at even strides.
    """
    w = Window.partitionBy("key")
    front, back = _edges(k)
    tokens = F.floor(F.octet_length("json") / 4) + F.floor(F.octet_length("name") / 4) + 2
    rows = entries.withColumns({"_p": F.row_number().over(w.orderBy("i")) - 1, "_n": F.count("*").over(w), "_tokens": tokens, "_failing": has_error_word(F.col("json"))})
    edge = (F.col("_p") < front) | (F.col("_p") >= F.col("_n") - back)
    rows = rows.withColumn("_keep", F.col("_failing") | (F.col("_tokens") <= SMALL) | edge)
    rows = rows.withColumns({"_kept": F.sum(F.col("_keep").cast("int")).over(w), "_all": F.sum("_tokens").over(w), "_fails": F.sum(F.col("_failing").cast("int")).over(w)})
    budget = F.greatest(F.lit(0), k - F.col("_kept"))
    stride = F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / (budget + 1)).cast("int"))
    rows = rows.withColumn("_asked", (budget > 0) & ~F.col("_keep") & (F.col("_p") % stride == 0))
    turn = F.sum(F.col("_asked").cast("int")).over(w.orderBy("_p"))
    whole = (F.col("_n") <= WHOLE) | (F.col("_all") < least_tokens) | (F.col("_n") <= k)
    rows = rows.withColumn("_stays", whole | F.col("_keep") | (F.col("_asked") & (turn <= k + F.col("_fails") - F.col("_kept"))))
    return rows.where("_stays").select(*entries.columns)


def kept_items(items: DataFrame, k: int) -> DataFrame:
    """Row 200: ``items(key, i, item)`` of arrays that stay, each kind of item cut by its own rule and put back in order.

    Kinds with under five items, nulls, booleans and arrays stay.  Strings by ``kept_strings``, and whatever equals one that stays; objects likewise, by their JSON;
    numbers at the ends and far from their mean.  Arrays of eight items at most stay whole.
    """
    tag = type_tag(F.col("item"))
    kind = F.when(tag == "string", "string").when(tag.isin("int", "float"), "number").when(tag == "object", "object").otherwise("other")
    w, group = Window.partitionBy("key"), Window.partitionBy("key", "_kind")
    text = F.when(kind == "string", F.try_variant_get("item", "$", "string")).otherwise(F.to_json("item"))
    rows = items.select(*items.columns, kind.alias("_kind"), F.count("*").over(w).alias("_all"), F.coalesce(text, F.lit("null")).alias("value")).withColumn("_of", F.count("*").over(group))
    whole = (F.col("_all") <= WHOLE) | (F.col("_of") < LEAST) | (F.col("_kind") == "other")
    rows = rows.withColumn("_whole", whole)
    texts = rows.where("NOT _whole AND _kind IN ('string', 'object')")
    same = kept_strings(texts.select("key", "i", "_kind", "value"), k, ("key", "_kind")).select("key", "_kind", "value").distinct()
    by_text = texts.join(same, ["key", "_kind", "value"], "left_semi")
    front, back = _edges(k)
    place = F.row_number().over(group.orderBy("i")) - 1
    numbers = rows.where("NOT _whole AND _kind = 'number'").withColumns({"_p": place, "_x": F.try_variant_get("item", "$", "double")})
    by_number = numbers.withColumn("_stays", (F.col("_p") < front) | (F.col("_p") >= F.col("_of") - back) | _far(F.col("_x"), group)).where("_stays")
    return reduce(DataFrame.union, [x.select(*items.columns) for x in (rows.where("_whole"), by_text, by_number)])


def _children(level: DataFrame) -> DataFrame:
    each = exploded_fields(level.select("id", "at", "value"), "value")
    step = F.when(F.col("_name").isNull(), F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), json_string(F.col("_name"))))
    return each.select("id", F.col("at").alias("parent"), F.concat("at", step).alias("at"), F.col("_at").alias("i"), F.col("_name").alias("name"), F.col("_value").alias("value"))


def crushed(documents: DataFrame, k: int, depth: int = 50, least_tokens: int = LEAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Row 202: ``id, json`` of every document of ``documents(id, value)``, and ``id, at, i, name, json`` of what was taken out.

    Arrays of five items or more that don't hold arrays or booleans only are cut by ``kept_items`` and stay as they are below; an array that lost objects gets one more
    at its end, which names how many and their hash.  Objects are cut by ``kept_keys``, then opened, and so are other arrays.  A null value gives null.
    Levels are written one by one; below ``depth`` of them nothing is cut.
    """
    shared_folder(documents.sparkSession)
    level = documents.select("id", F.lit(None).cast("string").alias("parent"), F.lit("$").alias("at"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("name"), "value")
    nodes, taken = [], []
    for d in range(depth + 1):
        tag = type_tag(F.col("value"))
        level = level.withColumn("tag", F.when(tag.isin("array", "object"), tag).otherwise("leaf") if d < depth else F.lit("leaf")).checkpoint()
        opened = level.where("tag != 'leaf'")
        if not opened.limit(1).count():
            nodes.append(level.select("id", "parent", "at", "i", "name", "tag", F.to_json("value").alias("json")))
            break
        children = _children(opened).checkpoint()
        kinds = children.where("name IS NULL").groupBy("id", F.col("parent").alias("at")).agg(F.count("*").alias("n"), F.bool_and(type_tag(F.col("value")).isin("array", "bool", "null")).alias("plain"))
        cut = kinds.where((F.col("n") >= LEAST) & ~F.col("plain")).select("id", "at", F.lit(True).alias("cut"))
        level = level.join(cut, ["id", "at"], "left")
        nodes.append(level.select("id", "parent", "at", "i", "name", "tag", F.when(F.col("tag") == "leaf", F.to_json("value")).alias("json")))
        arrays = children.join(cut.select("id", F.col("at").alias("parent")), ["id", "parent"], "left_semi").withColumn("key", F.struct("id", "parent"))
        items = arrays.select("key", "i", "at", F.col("value").alias("item"))
        stay = kept_items(items, k).select(F.col("key.id").alias("id"), "at").withColumn("stays", F.lit(True))
        told = arrays.join(stay, ["id", "at"], "left").select("id", "parent", "at", "i", "name", type_tag(F.col("value")).alias("kind"), F.to_json("value").alias("json"), F.coalesce("stays", F.lit(False)).alias("stays")).checkpoint()
        lost = told.where("NOT stays")
        taken.append(lost.select("id", F.col("parent").alias("at"), "i", "name", "json"))
        objects = lost.where("kind = 'object'").groupBy("id", "parent").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("i", "json")))["json"].alias("rows"))
        mark = F.concat(F.lit('{"_ccr_dropped":"'), marker(F.substring(F.sha2(F.array_join("rows", "\n"), 256), 1, 12), F.col("n")), F.lit('"}'))
        end = objects.select("id", "parent", F.concat("parent", F.lit("[end]")).alias("at"), F.lit(2**31 - 1).alias("i"), F.lit(None).cast("string").alias("name"), F.lit("leaf").alias("tag"), mark.alias("json"))
        nodes += [told.where("stays").select("id", "parent", "at", "i", "name", F.lit("leaf").alias("tag"), "json"), end]
        entries = children.where("name IS NOT NULL").select(F.struct("id", "parent").alias("key"), "i", "name", F.to_json("value").alias("json"), "at")
        chosen = kept_keys(entries, k, least_tokens).select(F.col("key.id").alias("id"), "at")
        fields = children.where("name IS NOT NULL")
        taken.append(fields.join(chosen, ["id", "at"], "left_anti").select("id", F.col("parent").alias("at"), "i", "name", F.to_json("value").alias("json")))
        others = children.where("name IS NULL").join(cut.select("id", F.col("at").alias("parent")), ["id", "parent"], "left_anti")
        level = fields.join(chosen, ["id", "at"], "left_semi").unionByName(others)
    every = reduce(DataFrame.union, nodes).checkpoint()
    # from the deepest level up: an array or object is made of what its children have become
    built, up = every.where("tag = 'leaf'").select("id", "parent", "at", "i", "name", "json"), every.where("tag != 'leaf'").drop("json")
    for _ in range(depth + 1):
        if not up.limit(1).count():
            break
        open_ = up.select("id", F.col("parent").alias("at")).distinct()
        ready = up.join(open_, ["id", "at"], "left_anti")
        part = F.struct("i", F.concat(F.coalesce(F.concat(json_string(F.col("name")), F.lit(":")), F.lit("")), "json").alias("json"))
        inner = built.groupBy("id", F.col("parent").alias("at")).agg(F.array_join(F.sort_array(F.collect_list(part))["json"], ",").alias("inner"))
        whole = ready.join(inner, ["id", "at"], "left")
        text = F.concat(F.when(F.col("tag") == "array", "[").otherwise("{"), F.coalesce("inner", F.lit("")), F.when(F.col("tag") == "array", "]").otherwise("}"))
        done = whole.select("id", "parent", "at", "i", "name", text.alias("json"))
        built = built.join(ready.select("id", F.col("at").alias("parent")), ["id", "parent"], "left_anti").unionByName(done).checkpoint()
        up = up.join(ready.select("id", "at"), ["id", "at"], "left_anti").checkpoint()
    return documents.select("id").join(built.where("at = '$'").select("id", "json"), "id", "left"), reduce(DataFrame.union, taken, every.limit(0).select("id", "at", "i", "name", "json"))
