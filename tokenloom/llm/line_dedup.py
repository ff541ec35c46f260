"""Lines that many documents hold, dropped from every one of them; DataFrame functions only.

Lines are exploded with their places, normalised and hashed.  The distinct documents of each hash are counted,
lines whose hash reaches the threshold are dropped, and the others are put together again by their places.

The exploded table has numbers only: places, hashes and a key of the document.  Texts are shuffled once, to meet the places
that they lose.  The ``HEAD`` most frequent hashes are broadcast; any other one then has at most one line in
``HEAD`` of all, so that no key of the shuffled join is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

#: Hashes that are broadcast, at 16 bytes each.
HEAD = 10_000
#: The bytes that are stripped from a line's ends, and the letters that are lower-cased.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    """128 bits of the columns, as two numbers that Spark groups and joins well."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(31), *columns)


def exploded_lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """``a, b, doc_id, place, h, g``: every line with a key of ``least_chars`` code points or more.

    ``a, b`` name the row's doc_id and text, ``h, g`` the line's key.
    """
    a, b = two_hashes(F.col("doc_id"), F.col("text"))
    named = docs.select(a.alias("a"), b.alias("b"), "doc_id", "text")  # before the lines are, or each would hash the text again
    lines = named.select("a", "b", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = lines.select("a", "b", "doc_id", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    h, g = two_hashes(F.col("key"))
    return keyed.select("a", "b", "doc_id", "place", h.alias("h"), g.alias("g"))


def frequent_lines(lines: DataFrame, at_least: int) -> DataFrame:
    """``h, g, documents`` of the hashes that ``at_least`` documents hold.

    Rows that share a doc_id are one document; a row without doc_id is a document for each line that it holds.
    """
    documents = F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())
    return lines.groupBy("h", "g").agg(documents.alias("documents")).where(F.col("documents") >= at_least)


def without_common_lines(docs: DataFrame, at_least: int = 10, least_chars: int = 1, head: int = HEAD) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and the rest of each text in ``text``.

    A text is split at ``\\n`` only; null and empty texts are one empty line, whose rest is empty.  Columns of the input that
    are called ``n_lines`` or ``n_dropped`` are replaced, all others come through.  Every row comes back once, repeated rows too;
    an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = scratch.save(exploded_lines(docs, least_chars), "lines")
    frequent = scratch.save(frequent_lines(lines, at_least), "frequent")
    top = frequent.orderBy(F.desc("documents"), "h", "g").limit(head).select("h", "g", F.lit(True).alias("common"))
    known = lines.drop("doc_id").join(F.broadcast(top), ["h", "g"], "left")
    rare = frequent.join(F.broadcast(top), ["h", "g"], "left_anti").select("h", "g")
    places = known.where("common").select("a", "b", "place").union(known.where("common IS NULL").join(rare, ["h", "g"], "left_semi").select("a", "b", "place"))
    lost = scratch.save(places.groupBy("a", "b").agg(F.sort_array(F.collect_set("place")).alias("lost")), "places")

    a, b = two_hashes(F.col("doc_id"), F.col("text"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]).alias("row"), a.alias("a"), b.alias("b"))
    met = row.join(lost, ["a", "b"], "left")
    # the array holds the lines once for all places that are looked up
    cut = F.array(F.split("row.text", "\n", -1))
    rest = F.transform(cut, lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("lost")), lambda i: own[i]), "\n"))[0]
    found = met.select("row", F.size(F.split("row.text", "\n", -1)).cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(rest).alias("rest"))
    kept = [F.col("rest").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return found.select(*kept, "n_lines", "n_dropped")
