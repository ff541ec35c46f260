"""What reads of files repeat, and when they have done their work (inventory rows 132, 346, 347).

Events are rows ``session, at, path, kind, low, high, bytes``: a read or write of the lines from low to high - 1.  Windows are those of one
line of a file, or of one file, of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_lines(events: DataFrame) -> DataFrame:
    """``session, path, line, at, kind, low, high, bytes, before, rewritten``: what the session did last with each line, and whether it writes it later.

    A read at the time of a write comes first.
    """
    each = events.where("low < high AND path IS NOT NULL").select("session", "path", "at", "kind", "low", "high", "bytes", F.explode(F.sequence("low", F.col("high") - 1)).alias("line"))
    order = Window.partitionBy("session", "path", "line").orderBy("at", "kind", "low", "high")
    later = F.max((F.col("kind") == "write").cast("int")).over(order.rowsBetween(1, Window.unboundedFollowing))
    return each.withColumns({"before": F.lag("kind").over(order), "rewritten": F.coalesce(later, F.lit(0)) == 1})


def audited_reads(events: DataFrame) -> DataFrame:
    """Row 132: of every read ``fresh``, ``repeated``, ``written_back`` and ``stale`` lines, bytes by lines, and ``verdict``.

    A line is repeated where the session's last event there was a read, written back where it was a write, else fresh; a line that a later write
    changes is stale besides.  The verdict is what all lines are: repeated, written_back or fresh; else mixed.  Equal reads at one time are one.
    Reads without lines have no verdict and no row.
    """
    lines = read_lines(events).where("kind = 'read'")
    count = lambda c: F.count_if(c)
    found = lines.groupBy("session", "path", "at", "low", "high", "bytes").agg(
        count(F.col("before").isNull()).alias("fresh"), count(F.col("before") == "read").alias("repeated"), count(F.col("before") == "write").alias("written_back"), count(F.col("rewritten")).alias("stale")
    )
    n = F.col("fresh") + F.col("repeated") + F.col("written_back")
    verdict = F.when(F.col("repeated") == n, "repeated").when(F.col("written_back") == n, "written_back").when(F.col("fresh") == n, "fresh").otherwise("mixed")
    part = lambda c: F.floor(F.col("bytes") * F.col(c) / n).cast("long").alias(f"{c}_bytes")
    return found.select("session", "path", "at", "low", "high", "fresh", "repeated", "written_back", "stale", *(part(c) for c in ("repeated", "written_back", "stale")), verdict.alias("verdict"))


def read_report(reads: DataFrame, *by: str) -> DataFrame:
    """Row 132: reads and bytes by verdict."""
    return reads.groupBy(*by, "verdict").agg(F.count("*").alias("reads"), *(F.sum(f"{c}_bytes").alias(f"{c}_bytes") for c in ("repeated", "written_back", "stale")))


def matured_reads(events: DataFrame, quiet: int, hold: int, ends: DataFrame) -> DataFrame:
    """Rows 346 and 347: ``session, path, at, matures`` of every read: when its file has been quiet for ``quiet`` or it was held for ``hold``, null where the session ends before.

    ``events(session, at, path, kind)``: every read and write of a file is activity; ``ends(session, end)`` is the last time of a session.  What is past the quiet time of an
    earlier read doesn't hold that read any more.
    """
    touches = events.where("path IS NOT NULL").select("session", "path", "at").distinct()
    w = Window.partitionBy("session", "path").orderBy("at")
    rests = touches.withColumn("next", F.lead("at").over(w)).withColumn("rests", F.when(F.col("next").isNull() | (F.col("next") - F.col("at") >= quiet), F.col("at") + quiet))
    first = F.min("rests").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    quiets = rests.select("session", "path", "at", first.alias("quiet_at"))
    reads = events.where("kind = 'read' AND path IS NOT NULL").select("session", "path", "at").join(quiets, ["session", "path", "at"]).join(ends, "session")
    matures = F.least("quiet_at", F.col("at") + hold)
    return reads.select("session", "path", "at", F.when(matures <= F.col("end"), matures).alias("matures"))
