"""Readers, in-column parsers and text sinks (inventory rows 5, 6, 8-12, 15, 24, 26, 31, 32, 317)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READERS = {"parquet": "parquet", "jsonl": "json", "json": "json", "csv": "csv", "orc": "orc", "text": "text"}


def read(spark: SparkSession, url: str, schema: StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """Rows 5, 6, 8, 26: a table by the kind that its name ends in; bad JSON and CSV lines are left out."""
    kind = kind or READERS[url.rstrip("/").rsplit(".", 1)[-1]]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("json", "csv"):
        reader = reader.option("mode", "DROPMALFORMED")
    if kind == "csv":
        reader = reader.option("header", "true")
    return reader.format(kind).load(url)


def write_csv(rows: DataFrame, url: str) -> None:
    """Row 31."""
    rows.write.mode("overwrite").option("header", "true").csv(url)


def cells(line: Column, kind: str) -> Column:
    """Rows 9-11: the cells of a line of CSV without quotes, TSV, a Markdown table or columns set apart by blanks."""
    if kind == "markdown":
        return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    if kind == "fixed":
        return F.split(F.trim(line), r"\s{2,}")
    return F.split(line, {"csv": ",", "tsv": "\t"}[kind])


def parse_table(texts: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Rows 9-12: ``key, row, cells (by header name)`` of tables in texts; none of a text whose lines have different widths."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\|?[\s:|-]+\|?\s*$") if kind == "markdown" else F.trim(x) != "")
    rows = texts.select(key, F.transform(lines, lambda x: cells(x, kind)).alias("rows")).where(F.size("rows") > 1)
    header = F.element_at("rows", 1)
    even = rows.where(F.forall("rows", lambda r: F.size(r) == F.size(header)))
    return even.select(key, header.alias("header"), F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("row", "values")).select(key, "row", F.map_from_arrays("header", "values").alias("cells"))


def key_values(line: Column) -> Column:
    """Row 24: ``name=value`` pairs of a line."""
    return F.map_from_entries(F.transform(F.array_distinct(F.regexp_extract_all(line, F.lit(r"(\w+)=(\S+)"), F.lit(0))), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r"=(.*)$", 1).alias("v"))))


def joined_json(text: Column) -> Column:
    """Row 15: objects one after another as one array, null where that is no JSON."""
    array = F.concat(F.lit("["), F.regexp_replace(F.trim(text), r"\}\s*\{", "},{"), F.lit("]"))
    return F.when(F.try_parse_json(array).isNotNull(), array)


def prometheus(rows: DataFrame, name: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Row 32: ``line`` for each row in text exposition."""
    quoted = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.col(x).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for x in labels]
    return rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *quoted), F.lit("} "), F.col(value).cast("string")).alias("line"))


def tagged_json(response: Column, tag: str, schema: str) -> Column:
    """Row 317: the JSON between a pair of tags."""
    return F.from_json(F.regexp_extract(response, rf"(?s)<{tag}>(.*?)</{tag}>", 1), schema)
