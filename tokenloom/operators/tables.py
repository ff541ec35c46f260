"""Arrays of JSON objects as tables with an exact inverse (inventory rows 224-228, 230-232, 235).

Arrays are rows ``key, pos, item``, item a VARIANT.  Their cells are one long table ``key, pos, path, value``; a missing field has no row,
a null one a null value.  Columns, types, buckets and texts come from groups of it, so that an array of any length is
spread; only a row's own cells and a table's own rows meet to become text.

A table's text is a line ``[rows]{column:type,...}`` and a line a row: its cells as JSON, after ``!`` and the numbers of the columns that it
lacks.  With buckets, each has such a table, told by ``field=value`` after its columns, and rows begin with ``@`` and their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.cluster import shared_folder

#: Inner fields that are flattened at most, the share of common fields below which an array is told apart by a field,
#: buckets, and rows that are all different.
INNER, CORE, BUCKETS, UNLIKE = 6, 0.6, (2, 8), 0.7
#: Bytes from which a string is opaque, share of base64 letters, opening brackets of a page's piece.
OPAQUE, BASE64_SHARE, BRACKETS = 256, 0.95, 3
PLAIN = r"[A-Za-z0-9_-]+"
_NAME = rf'(?:"(?:[^"\\]|\\.)*"|{PLAIN})'
_ONE = rf"{_NAME}(?:\.{_NAME})?\??:[a-z]+"
_COLUMN = rf"({_NAME}(?:\.{_NAME})?)\??:[a-z]+"
HEADER = rf"(?s)^\[([0-9]+)\]\{{((?:{_ONE}(?:,{_ONE})*)?)\}}(.*)\z"


def type_tag(value: Column) -> Column:
    """A cell's type: null, bool, int, float, string, array, object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("float")
    )


def cell_class(value: Column) -> Column:
    """Row 227: scalar, object, array, text_json (a string that holds an object or array), base64, html or long."""
    text = F.try_variant_get(value, "$", "string")
    tag = type_tag(value)
    inner = F.try_parse_json(text)
    holds = text.rlike(r"^\s*[\[{]") & inner.isNotNull()
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z0-9+/=_-]", "")) / F.length(text)
    base64 = ~text.rlike(r"[\s<>]") & (letters >= BASE64_SHARE)
    html = F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit(""))) >= BRACKETS
    opaque = F.when(base64, "base64").when(html, "html").otherwise("long")
    string = F.when(holds, "text_json").when(F.octet_length(text) > OPAQUE, opaque).otherwise("scalar")
    return F.when(tag.isin("object", "array"), tag).when(tag == "string", string).otherwise("scalar")


def skeleton(value: Column) -> Column:
    """Row 235: the keys and types of a document."""
    return F.schema_of_variant(value)


def exploded_fields(rows: DataFrame, value: str, outer: bool = False) -> DataFrame:
    """A row for each field or item of the VARIANT ``value``, with its ``_at``, ``_name`` (null for an array's) and ``_value``; ``outer``: one of nulls where there is none."""
    return rows.sparkSession.sql(f"SELECT r.*, e.pos AS _at, e.key AS _name, e.value AS _value FROM {{r}} r, LATERAL variant_explode{'_outer' * outer}(r.`{value}`) e", r=rows)


def cells(items: DataFrame) -> DataFrame:
    """``key, pos, path, value``: a row for each field of each item of arrays that hold objects only, uniform inner objects flattened (row 226).

    A field is flattened where every value of it is an object of the same one to six fields.
    """
    whole = items.where("item IS NOT NULL").select("key", "pos", "item", type_tag(F.col("item")).alias("tag"))
    pure = whole.groupBy("key").agg(F.bool_and(F.col("tag") == "object").alias("pure")).where("pure").select("key")
    each = exploded_fields(whole.join(pure, "key").select("key", "pos", "item"), "item").select("key", "pos", F.col("_name").alias("field"), F.col("_value").alias("value"))
    each = each.withColumn("tag", type_tag(F.col("value")))
    inner = F.when(F.col("tag") == "object", F.array_sort(F.json_object_keys(F.to_json("value"))))
    shapes = each.withColumn("inner", inner).groupBy("key", "field").agg(F.bool_and(F.col("tag") == "object").alias("objects"), F.min("inner").alias("low"), F.max("inner").alias("high"))
    flat = shapes.where(F.col("objects") & (F.col("low") == F.col("high")) & F.size("low").between(1, INNER)).select("key", "field", F.lit(True).alias("flat"))
    marked = each.join(flat, ["key", "field"], "left")
    plain = marked.where("flat IS NULL").select("key", "pos", F.array("field").alias("path"), "value", "tag")
    deep = exploded_fields(marked.where("flat").select("key", "pos", "field", "value"), "value")
    return plain.union(deep.select("key", "pos", F.array("field", "_name").alias("path"), F.col("_value").alias("value"), type_tag(F.col("_value")).alias("tag")))


def discriminators(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Row 225: ``key, field``: where under 0.6 of the fields are in every row, the field of strings in every row that has 2 to 8 values, the most, and not one for most rows; ties go to the first name."""
    columns = found.groupBy("key", F.slice("path", 1, 1).alias("path")).agg(F.count_distinct("pos").alias("n"), F.bool_and((F.size("path") == 1) & (F.col("tag") == "string")).alias("strings"), F.count_distinct(F.to_json("value")).alias("kinds"))
    core = columns.join(rows, "key").withColumn("core", (F.avg((F.col("n") == F.col("rows")).cast("double")).over(Window.partitionBy("key"))))
    fit = core.where((F.col("core") < CORE) & (F.col("n") == F.col("rows")) & F.col("strings") & F.col("kinds").between(*BUCKETS) & (F.col("kinds") / F.col("rows") <= UNLIKE))
    return fit.groupBy("key").agg(F.min_by("path", F.struct((-F.col("kinds")).alias("kinds"), "path")).alias("field"))


def json_string(name: Column) -> Column:
    """A string as JSON; null for null."""
    return F.when(name.isNotNull(), F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]\z", 1))


def _quoted(name: Column) -> Column:
    return F.when(name.rlike(rf"^{PLAIN}\z"), name).otherwise(json_string(name))


def _told_cells(items: DataFrame) -> DataFrame:
    """``key, pos, by, bucket, rows, path, value, tag``: the cells of arrays that hold objects only, each with its bucket and the rows of that; an empty object is a row whose path is null.

    As ``cells`` and ``discriminators`` find them, by windows of one array, field or row: what is dealt out by key once stays where it is.
    """
    of = lambda *by: Window.partitionBy("key", *by)
    whole = items.where("item IS NOT NULL").select("key", "pos", "item", type_tag(F.col("item")).alias("tag"))
    whole = whole.select("key", "pos", "item", F.bool_and((F.col("tag") == "object") & F.col("key").isNotNull()).over(of()).alias("pure"), F.count("*").over(of()).alias("all")).where("pure")
    each = exploded_fields(whole.select("key", "pos", "all", "item"), "item", outer=True).select("key", "pos", "all", F.col("_name").alias("field"), F.col("_value").alias("value"))
    each = each.withColumn("tag", type_tag(F.col("value")))
    inner = F.when(F.col("tag") == "object", F.array_sort(F.json_object_keys(F.to_json("value"))))
    each = each.withColumn("inner", inner).withColumn("json", F.when(F.col("tag") == "string", F.to_json("value")))
    sized = {"objects": F.bool_and(F.col("tag") == "object").over(of("field")), "low": F.min("inner").over(of("field")), "high": F.max("inner").over(of("field")), "strings": F.bool_and(F.col("tag") == "string").over(of("field")), "n": F.count("*").over(of("field"))}
    by_value = of("field").orderBy("json")
    each = each.withColumns(sized).withColumns({"kind": F.dense_rank().over(by_value), "nth": F.row_number().over(by_value)}).withColumn("kinds", F.max("kind").over(of("field")))
    flat = F.coalesce(F.col("objects") & (F.col("low") == F.col("high")) & F.size("low").between(1, INNER), F.lit(False))
    first, full = F.col("field").isNotNull() & (F.col("nth") == 1), F.col("n") == F.col("all")
    each = each.select("key", "pos", "all", "field", "value", "json", "n", "strings", "kinds", flat.alias("flat"), (F.count_if(first & full).over(of()) / F.count_if(first).over(of())).alias("core"))
    fit = F.col("field").isNotNull() & (F.col("core") < CORE) & full & F.col("strings") & F.col("kinds").between(*BUCKETS) & (F.col("kinds") / F.col("all") <= UNLIKE)
    each = each.withColumn("by", F.min(F.when(fit, F.struct((-F.col("kinds")).alias("kinds"), "field"))).over(of())["field"])
    bucket = F.coalesce(F.max(F.when(F.col("field") == F.col("by"), F.col("json"))).over(of("pos")), F.lit(""))
    one = (F.row_number().over(of("pos").orderBy("field")) == 1).cast("long")
    each = each.withColumns({"bucket": bucket, "one": one}).withColumn("rows", F.sum("one").over(of("bucket")))
    by = F.when(F.col("by").isNotNull(), F.array("by"))
    opened = exploded_fields(each.select("key", "pos", by.alias("by"), "bucket", "rows", "field", "value", F.when(F.col("flat"), F.col("value")).alias("open")), "open", outer=True)
    path = F.when(F.col("_name").isNotNull(), F.array("field", "_name")).when(F.col("field").isNotNull(), F.array("field"))
    value = F.when(F.col("_name").isNotNull(), F.col("_value")).otherwise(F.col("value"))
    return opened.select("key", "pos", "by", "bucket", "rows", path.alias("path"), value.alias("value")).withColumn("tag", type_tag(F.col("value")))


def tables(items: DataFrame) -> DataFrame:
    """Row 224: ``key, bucket, by, value, rows, columns, lines``: the tables of every array that holds objects only.

    ``columns`` are structs of path, type and ``optional`` (a row lacks it or has null), by frequency, then by name; a column of several types is ``json``.
    ``lines`` are the rows' texts in order.  An array without a discriminator is one bucket whose ``by`` is null.  Items are dealt out by key once.
    """
    found = _told_cells(items)
    column, bucket = Window.partitionBy("key", "bucket", "path"), Window.partitionBy("key", "bucket")
    tag = F.when(F.col("tag") != "null", F.col("tag"))
    found = found.withColumns({"n": F.count("*").over(column), "nulls": F.count_if(F.col("tag") == "null").over(column), "low": F.min(tag).over(column), "high": F.max(tag).over(column)})
    order = bucket.orderBy(F.col("path").isNull(), F.desc("n"), "path")
    found = found.withColumns({"c": F.when(F.col("path").isNotNull(), F.dense_rank().over(order) - 1), "nth": F.row_number().over(column.orderBy("pos"))}).withColumn("of", F.max("c").over(bucket) + 1)
    kind = F.when(F.col("low").isNull(), "null").when(F.col("low") == F.col("high"), F.col("low")).otherwise("json")
    head = F.struct("c", "path", kind.alias("type"), ((F.col("n") < F.col("rows")) | (F.col("nulls") > 0)).alias("optional"))
    named = F.col("path").isNotNull()
    row = found.groupBy("key", "bucket", "pos").agg(
        F.sort_array(F.collect_list(F.when(named, F.struct("c", F.to_json("value").alias("json"))))).alias("cells"), F.collect_list(F.when(named & (F.col("nth") == 1), head)).alias("heads"),
        F.first("of").alias("of"), F.first("by").alias("by"), F.first("rows").alias("rows"),
    )
    # an empty object lacks every column
    lacks = F.when(F.coalesce("of", F.lit(0)) > 0, F.array_except(F.sequence(F.lit(0), F.col("of") - 1), F.col("cells.c"))).otherwise(F.array().cast("array<int>"))
    text = F.concat(F.when(F.size(lacks) > 0, F.concat(F.lit("!"), F.array_join(lacks.cast("array<string>"), "."), F.lit(" "))).otherwise(""), F.array_join("cells.json", ","))
    told_place = F.when(F.col("by").isNotNull(), F.concat(F.lit("@"), F.col("pos").cast("string"), F.lit(" "))).otherwise("")
    line = row.select("key", "bucket", "by", "rows", "heads", F.struct("pos", F.concat(told_place, text).alias("line")).alias("line"))
    whole = line.groupBy("key", "bucket").agg(F.first("by").alias("by"), F.first("rows").alias("rows"), F.sort_array(F.flatten(F.collect_list("heads"))).alias("heads"), F.sort_array(F.collect_list("line"))["line"].alias("lines"))
    columns = F.transform("heads", lambda c: F.struct(c["path"].alias("path"), c["type"].alias("type"), c["optional"].alias("optional")))
    return whole.select("key", "bucket", "by", "rows", columns.alias("columns"), "lines")


def _name(path: Column) -> Column:
    return F.array_join(F.transform(path, _quoted), ".")


def csv_schema(found: DataFrame) -> DataFrame:
    """Row 230: ``key, text`` of ``tables``; buckets ascend by value."""
    column = F.transform("columns", lambda c: F.concat(_name(c["path"]), F.when(c["optional"], "?").otherwise(""), F.lit(":"), c["type"]))
    tail = F.when(F.col("by").isNotNull(), F.concat(_name(F.col("by")), F.lit("="), "bucket")).otherwise("")
    text = F.concat(F.lit("["), F.col("rows").cast("string"), F.lit("]{"), F.array_join(column, ","), F.lit("}"), tail, F.lit("\n"), F.array_join("lines", "\n"))
    return found.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("bucket", text.alias("text"))))["text"], "\n").alias("text"))


def markdown_records(items: DataFrame) -> DataFrame:
    """Row 232: ``key, text``: the number of records, then each one's ``name: value`` lines, names ascending, records apart by an empty line."""
    found = cells(items)
    shown = F.coalesce(F.when(F.col("tag") == "string", F.try_variant_get("value", "$", "string")), F.to_json("value"))
    record = found.groupBy("key", "pos").agg(F.array_join(F.sort_array(F.collect_list(F.struct("path", F.concat(_name(F.col("path")), F.lit(": "), shown).alias("line"))))["line"], "\n").alias("text"))
    return record.groupBy("key").agg(F.concat(F.count("*").cast("string"), F.lit(" records\n\n"), F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], "\n\n")).alias("text"))


def json_tables(found: DataFrame) -> DataFrame:
    """Row 231: ``key, json``: the tables as one JSON array of their columns and rows."""
    one = F.struct("by", "bucket", "rows", "columns", "lines")
    return found.groupBy("key").agg(F.to_json(F.sort_array(F.collect_list(F.struct("bucket", one.alias("t"))))["t"]).alias("json"))


def restored(texts: DataFrame) -> DataFrame:
    """``key, pos, item`` (VARIANT) from ``key, text`` of ``csv_schema``; without buckets places count from 0.

    A line's columns are those of the last header above it, by a window of its table: texts that are dealt out by key stay where they are.
    """
    lines = texts.select("key", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("head", F.col("line").rlike(HEADER))
    w = Window.partitionBy("key").orderBy("n")
    parts = lambda name: F.transform(F.regexp_extract_all(name, F.lit(_NAME), F.lit(0)), lambda p: F.when(p.startswith('"'), F.try_variant_get(F.try_parse_json(p), "$", "string")).otherwise(p))
    inner = F.regexp_extract("line", HEADER, 2)
    lines = lines.withColumn("own", F.when(F.col("head"), F.transform(F.regexp_extract_all(inner, F.lit(_COLUMN), F.lit(1)), parts)))
    marked = lines.withColumns({"columns": F.last("own", True).over(w), "place": F.sum((~F.col("head")).cast("long")).over(w) - 1})
    row = marked.where("NOT head").select("key", "place", "columns", *[F.regexp_extract("line", r"(?s)^(?:@([0-9]+) )?(?:!([0-9.]+) )?(.*)\z", k).alias(c) for k, c in ((1, "at"), (2, "lacks"), (3, "cells"))])
    row = row.withColumn("pos", F.when(F.col("at") != "", F.col("at").cast("long")).otherwise(F.col("place")))
    gone = F.when(F.col("lacks") == "", F.array().cast("array<int>")).otherwise(F.split("lacks", r"\.").cast("array<int>"))
    has = F.array_except(F.when(F.size("columns") > 0, F.sequence(F.lit(0), F.size("columns") - 1)).otherwise(F.array().cast("array<int>")), gone)
    row = row.select("key", "pos", F.transform(has, lambda i: F.col("columns")[i]).alias("paths"), F.parse_json(F.concat(F.lit("["), "cells", F.lit("]"))).alias("values"))
    each = exploded_fields(row, "values", outer=True).select("key", "pos", F.get("paths", F.col("_at")).alias("path"), F.to_json("_value").alias("json"))
    field = lambda name, value: F.concat(json_string(name), F.lit(":"), value)
    whole = lambda pairs: F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    # an inner object's fields share its name; an empty object has a row without a path
    deep = F.when(F.size("path") == 2, field(F.get("path", F.lit(1)), F.col("json")))
    fields = each.groupBy("key", "pos", F.get("path", F.lit(0)).alias("name")).agg(F.collect_list(deep).alias("deep"), F.first("json").alias("json"))
    value = F.when(F.size("deep") > 0, whole(F.col("deep"))).otherwise(F.col("json"))
    objects = fields.groupBy("key", "pos").agg(whole(F.collect_list(field(F.col("name"), value))).alias("json"))
    return objects.select("key", "pos", F.parse_json("json").alias("item"))


def inner_arrays(documents: DataFrame, depth: int = 32) -> DataFrame:
    """Row 228: ``id, at, pos, item``: the items of every array anywhere in ``documents(id, value)``, ``at`` being its path; strings that hold JSON are gone into.

    A level's arrays and objects are written before the next one's; what lies below ``depth`` levels stays in their items.
    """
    shared_folder(documents.sparkSession)
    level, found = documents.select("id", F.lit("$").alias("at"), "value"), []
    for _ in range(depth):
        told = level.withColumn("class", cell_class(F.col("value"))).where("class IN ('array', 'object', 'text_json')")
        inner = F.try_parse_json(F.try_variant_get("value", "$", "string"))
        level = told.select("id", "at", F.when(F.col("class") == "text_json", inner).otherwise(F.col("value")).alias("value")).checkpoint()
        if not level.limit(1).count():
            break
        each = exploded_fields(level, "value")
        found.append(each.where("_name IS NULL").select("id", "at", F.col("_at").cast("long").alias("pos"), F.col("_value").alias("item")))
        name = F.when(F.col("_name").isNull(), F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), _quoted(F.col("_name"))))
        level = each.select("id", F.concat("at", name).alias("at"), F.col("_value").alias("value"))
    none = documents.limit(0).select("id", F.lit("$").alias("at"), F.lit(0).cast("long").alias("pos"), F.col("value").alias("item"))
    return reduce(DataFrame.union, found, none)
