"""Spans of lines that a session has shown before, folded into pointers (inventory rows 248 and 249).

A block is a session's row, its number the place by turn.  Windows of ``least`` neighbouring lines are hashed; a line
number before a line counts by its distance to the window's first one, so that lines which moved as a whole
are the same.  A window that an earlier block has points to the earliest such block, the r-th of its kind in a block to
the r-th there.  Windows on one diagonal touch and make up spans; a line goes to the longest span over it.

What a block becomes depends on earlier blocks alone, so a turn that is added changes none before it.  Everything
is an equijoin or a window within one text; a window that very many blocks have is met by broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.cluster import shared_folder
from tokenloom.operators.skew import join_counted

#: A line number before a line: blanks, digits, one of tab, colon, bar or arrow.
NUMBER = r"^( *)(0|[1-9][0-9]{0,8})([\t:|→])"
#: A pointer's line, as it is written and as it is told from text that looks like one.
POINTER = r"^\[\[([0-9]+) lines of block ([0-9]+) from ([0-9]+), numbers ([+-][0-9]+)\]\]\z"
ALIKE = r"^\\*\[\[[0-9]+ lines of block "
#: Stands for a line without a number among distances.
_NONE = -(1 << 40)
_BLOCK = ["session", "block"]


def blocks(rows: DataFrame, session: str, turn: str, text: str, protected: Column | None = None) -> DataFrame:
    """``session, block, turn, text, protected``: the session's rows numbered by turn, null first; equal turns by text.  Null text is empty."""
    kept = F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))
    named = rows.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), kept.alias("protected"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.asc_nulls_first("turn"), "text", "protected")) - 1
    return named.select("session", place.cast("long").alias("block"), "turn", "text", "protected")


def _lines(found: DataFrame) -> DataFrame:
    lines = found.select(*_BLOCK, F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    part = lambda k: F.regexp_extract("line", NUMBER, k)
    numbered = part(2) != ""
    head = F.length(part(1)) + F.length(part(2))
    # a padded number keeps its width
    width = F.when(numbered, F.when(part(1) == "", 0).otherwise(head)).otherwise(-1)
    body = F.when(numbered, F.expr("substring(line, length(regexp_extract(line, '{0}', 1)) + length(regexp_extract(line, '{0}', 2)) + 1)".format(NUMBER.replace("\\", "\\\\")))).otherwise(F.col("line"))
    return lines.select(*_BLOCK, "n", "line", F.when(numbered, part(2).cast("long")).alias("number"), width.alias("width"), body.alias("body"))


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """``session, block, h, g, places``: each different window of a block and where it stands, with its first number."""
    hashed = lines.select(*_BLOCK, "n", "number", F.xxhash64("width", "body").alias("a"), F.xxhash64(F.lit(31), "width", "body").alias("b"))
    order = Window.partitionBy(*_BLOCK).orderBy("n")
    ahead = lambda c: [F.lead(c, k).over(order) for k in range(least)]
    rows = hashed.select(*_BLOCK, "n", F.array(*ahead("a")).alias("a"), F.array(*ahead("b")).alias("b"), F.array(*ahead("number")).alias("numbers")).where(F.col("a")[least - 1].isNotNull())
    base = F.filter("numbers", lambda x: x.isNotNull())
    rows = rows.withColumn("base", F.when(F.size(base) > 0, F.element_at(base, 1)))
    apart = F.transform("numbers", lambda x: F.coalesce(x - F.col("base"), F.lit(_NONE)))
    rows = rows.select(*_BLOCK, "n", "base", F.xxhash64("a", apart).alias("h"), F.xxhash64("b", apart).alias("g"))
    return rows.groupBy(*_BLOCK, "h", "g").agg(F.sort_array(F.collect_list(F.struct("n", "base"))).alias("places"))


def repeated_spans(found: DataFrame, least: int = 3) -> DataFrame:
    """``session, block, low, high, of, first, shift``: lines low to high - 1 are those of block ``of`` from line ``first`` on, their numbers ``shift`` more."""
    windows = _windows(_lines(found), least)
    key = ["session", "h", "g"]
    sources = windows.groupBy(*key).agg(F.min("block").alias("of"), F.min_by("places", "block").alias("source"), F.count("*").alias("blocks")).where("blocks > 1")
    met = join_counted(windows, sources, key, "blocks").where(F.col("block") > F.col("of"))
    pairs = F.transform("places", lambda p, i: F.struct(p["n"].alias("n"), p["base"].alias("base"), F.element_at("source", F.least(i + 1, F.size("source"))).alias("from")))
    each = met.select(*_BLOCK, "of", F.explode(pairs).alias("p")).select(*_BLOCK, "of", F.col("p.n").alias("n"), (F.col("p.n") - F.col("p.from.n")).alias("diagonal"), F.coalesce(F.col("p.base") - F.col("p.from.base"), F.lit(0)).alias("shift"))
    along = [*_BLOCK, "of", "diagonal", "shift"]
    w = Window.partitionBy(*along).orderBy("n")
    begins = F.coalesce(F.col("n") - F.lag("n").over(w) > least, F.lit(True)).cast("int")
    islands = each.withColumn("begins", begins).withColumn("island", F.sum("begins").over(w)).groupBy(*along, "island").agg(F.min("n").alias("low"), (F.max("n") + least).alias("high"))
    line = islands.select(*_BLOCK, F.explode(F.sequence("low", F.col("high") - 1)).alias("n"), F.struct((F.col("high") - F.col("low")).alias("size"), (-F.col("low")).alias("early"), (-F.col("of")).alias("old"), "diagonal", "shift").alias("by"))
    best = line.groupBy(*_BLOCK, "n").agg(F.max("by").alias("by"))
    spans = best.groupBy(*_BLOCK, "by").agg(F.min("n").alias("low"), (F.max("n") + 1).alias("high")).where(F.col("high") - F.col("low") >= least)
    return spans.select(*_BLOCK, "low", "high", (-F.col("by.old")).alias("of"), (F.col("low") - F.col("by.diagonal")).alias("first"), F.col("by.shift").alias("shift"))


def pointer(count: Column, of: Column, first: Column, shift: Column) -> Column:
    return F.concat(F.lit("[["), count.cast("string"), F.lit(" lines of block "), of.cast("string"), F.lit(" from "), (first + 1).cast("string"), F.lit(", numbers "), F.when(shift < 0, "").otherwise("+"), shift.cast("string"), F.lit("]]"))


def fold_repeats(found: DataFrame, least: int = 3, least_chars: int = 40) -> DataFrame:
    """Row 248: ``session, block, turn, protected, text, spans, lines, chars`` of every row of ``blocks``, repeated spans of its text folded.

    A span is folded where it has ``least`` lines and ``least_chars`` characters and its pointer is shorter; ``lines`` and ``chars`` are what
    that took out.  Lines that look like pointers get a backslash in front.  Protected rows stay as they are but can be
    pointed to, and so do rows without a session, to which nothing points.  An empty table gives no rows.
    """
    spans = repeated_spans(found.where("session IS NOT NULL"), least)
    lines = found.select(*_BLOCK, "protected", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    inside = spans.select(*_BLOCK, F.explode(F.sequence("low", F.col("high") - 1)).alias("n"), "low", "high", "of", "first", "shift")
    placed = lines.where("session IS NOT NULL AND NOT protected").join(inside, [*_BLOCK, "n"], "left")
    span = Window.partitionBy(*_BLOCK, "low")
    mark = pointer(F.col("high") - F.col("low"), F.col("of"), F.col("first"), F.col("shift"))
    sized = placed.withColumns({"mark": mark, "chars": F.sum(F.length("line") + 1).over(span) - 1})
    folds = F.coalesce((F.col("chars") >= least_chars) & (F.length("mark") < F.col("chars")), F.lit(False))
    one = sized.withColumn("folds", folds).where(~F.col("folds") | (F.col("n") == F.col("low")))
    shown = F.when(F.col("folds"), F.col("mark")).when(F.col("line").rlike(ALIKE), F.concat(F.lit("\\"), "line")).otherwise(F.col("line"))
    saved = lambda c: F.sum(F.when(F.col("folds"), c).otherwise(0))
    whole = one.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list(F.struct("n", shown.alias("line")))).alias("shown"), F.sum(F.col("folds").cast("long")).alias("spans"), saved(F.col("high") - F.col("low")).alias("lines"), saved(F.col("chars") - F.length("mark")).alias("chars"))
    out = whole.select(*_BLOCK, F.array_join("shown.line", "\n").alias("folded"), "spans", "lines", "chars")
    none = F.lit(0).cast("long")
    return found.join(out, _BLOCK, "left").select(*_BLOCK, "turn", "protected", F.coalesce("folded", "text").alias("text"), *[F.coalesce(c, none).alias(c) for c in ("spans", "lines", "chars")])


def _shifted(line: Column, shift: Column) -> Column:
    """The line with its number ``shift`` more, a padded one in its width."""
    blanks, digits = (F.regexp_extract(line, NUMBER, k) for k in (1, 2))
    number = (digits.cast("long") + shift).cast("string")
    head = F.length(blanks) + F.length(digits)
    padded = F.when(blanks == "", number).otherwise(F.lpad(number, F.greatest(head, F.length(number)), " "))
    return F.when((digits == "") | (shift == 0), line).otherwise(F.concat(padded, F.substr(line, head + 1)))


def unfold_repeats(folded: DataFrame) -> DataFrame:
    """``session, block, turn, text`` as ``fold_repeats`` found them, from its rows alone.

    Pointers to lines that are folded themselves follow those lines' pointers, twice as far in each round.  Only places go through the rounds;
    lines are written once and meet the places in the end.
    """
    spark = folded.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/tokenloom-unfold-{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    own = folded.where("session IS NOT NULL").select(*_BLOCK, "protected", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    part = lambda k: F.when(F.col("protected"), "").otherwise(F.regexp_extract("line", POINTER, k))
    parsed = own.withColumn("count", F.when(part(1) != "", part(1).cast("long")).otherwise(1))
    begins = F.sum("count").over(Window.partitionBy(*_BLOCK).orderBy("k")) - F.col("count")
    wide = parsed.withColumn("begins", begins).select(*_BLOCK, "protected", "begins", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    literal = F.when(~F.col("protected") & F.col("line").rlike(ALIKE) & (part(1) == ""), F.substr("line", F.lit(2))).otherwise(F.col("line"))
    is_pointer = part(1) != ""
    rows = wide.select(
        *_BLOCK, (F.col("begins") + F.col("i")).alias("n"), F.when(~is_pointer, literal).alias("line"), F.when(is_pointer, part(2).cast("long")).alias("of"),
        F.when(is_pointer, part(3).cast("long") - 1 + F.col("i")).alias("at"), F.when(is_pointer, part(4).cast("long")).otherwise(0).alias("shift"),
    )
    rows = saved(rows, "rows")
    literal = rows.where("of IS NULL").select(*_BLOCK, "n", "line")
    places, moved, number = rows.where("of IS NOT NULL").select(*_BLOCK, "n", "of", "at", "shift"), True, 0
    while moved:
        known = places.select("session", F.col("block").alias("of"), F.col("n").alias("at"), F.col("of").alias("_of"), F.col("at").alias("_at"), F.col("shift").alias("_shift"))
        met = places.join(known, ["session", "of", "at"], "left")
        next_ = met.select(*_BLOCK, "n", F.coalesce("_of", "of").alias("of"), F.coalesce("_at", "at").alias("at"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"), F.col("_of").isNotNull().alias("moved"))
        number += 1
        next_ = saved(next_, f"places-{number}")
        moved, places = next_.where("moved").limit(1).count() > 0, next_.drop("moved")
    source = literal.select("session", F.col("block").alias("of"), F.col("n").alias("at"), "line")
    resolved = places.join(source, ["session", "of", "at"]).select(*_BLOCK, "n", _shifted(F.col("line"), F.col("shift")).alias("line"))
    rows = literal.union(resolved)
    whole = rows.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return folded.join(whole.select(*_BLOCK, F.array_join("lines.line", "\n").alias("whole")), _BLOCK, "left").select(*_BLOCK, "turn", F.coalesce("whole", "text").alias("text"))


def changed_by_later_turns(found: DataFrame, until: int, least: int = 3, least_chars: int = 40) -> DataFrame:
    """Row 249: blocks below ``until`` that fold otherwise when the blocks from there on are absent: none."""
    whole = fold_repeats(found, least, least_chars).where(F.col("block") < until)
    part = fold_repeats(found.where(F.col("block") < until), least, least_chars)
    return whole.select(*_BLOCK, "text").exceptAll(part.select(*_BLOCK, "text"))
