"""Joins whose hot keys are known from a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast: the heaviest ones, at most so many rows.
HEAD = 10_000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], weight: str, head: int = HEAD) -> DataFrame:
    """``rows`` with what ``counted`` has for their key, inner; ``counted`` has each key once and in ``weight`` how many rows have it.

    The ``head`` heaviest keys are broadcast.  Any other key then has at most one row in ``head`` of all, so no task
    of the shuffled join gets a hot one.  Null keys meet nothing.
    """
    heavy = counted.orderBy(F.desc(weight), *on).limit(head)
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), on, "left")
    met = marked.where("_heavy").drop("_heavy")
    rest = marked.where("_heavy IS NULL").select(*rows.columns)
    light = counted.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return met.unionByName(rest.join(light, on).select(*met.columns))
