"""Columns over single texts and values (inventory rows 69, 201, 217, 234, 303, 304, 311, 313, 320, 322, 324-326, 330, 359, 413, 417, 455)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Models whose features depend on the version, and the first versions that have them.
GATED = {"claude": (4, 6), "gpt": (5, 4)}


def is_uuid(x: Column) -> Column:
    """Row 217."""
    return F.coalesce(x.rlike(UUID), F.lit(False))


def is_release_date(token: Column) -> Column:
    """Row 326: eight digits of a year from 2000 to 2100, a month and a day from 1 to 31."""
    part = lambda a, n: F.substring(token, a, n).try_cast("int")
    return F.coalesce(token.rlike(r"^\d{8}$") & part(1, 4).between(2000, 2100) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31), F.lit(False))


def model_version(model: Column) -> Column:
    """Row 69: ``family, major, minor`` of a model's name; null where it has no such version.  Dates are no versions."""
    parts = F.split(F.lower(model), r"[^a-z0-9]+")
    family = F.when(F.array_contains(parts, "claude"), "claude").when(F.array_contains(parts, "gpt"), "gpt")
    rest = F.slice(parts, F.array_position(parts, family).cast("int") + 1, F.size(parts))
    number = lambda t: t.rlike(r"^\d+$") & ~is_release_date(t) & ~t.rlike(r"^20\d\d$")
    skipped = F.aggregate(rest, F.struct(F.lit(False).alias("seen"), F.lit(False).alias("done"), F.array().cast("array<int>").alias("v")), lambda s, t: F.struct((s["seen"] | number(t)).alias("seen"), (s["done"] | (s["seen"] & ~number(t))).alias("done"), F.when(number(t) & ~s["done"], F.concat(s["v"], F.array(t.try_cast("int")))).otherwise(s["v"]).alias("v")))
    v = skipped["v"]
    return F.when(family.isNotNull() & (F.size(v) > 0), F.struct(family.alias("family"), v[0].alias("major"), F.coalesce(F.get(v, F.lit(1)), F.lit(0)).alias("minor")))


def has_feature(model: Column) -> Column:
    """Row 69: whether a model is of a gated family and of its first version or later."""
    v = model_version(model)
    out = F.lit(False)
    for family, (major, minor) in GATED.items():
        out = out | ((v["family"] == family) & ((v["major"] > major) | ((v["major"] == major) & (v["minor"] >= minor))))
    return F.coalesce(out, F.lit(False))


def array_kind(json: Column) -> Column:
    """Row 201: what a JSON array holds: one kind of value throughout, a mixture, or nothing."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    schema = F.transform(items, lambda v: F.regexp_replace(F.schema_of_variant(v), r"[<(].*$", ""))
    kind = F.transform(schema, lambda s: F.when(s == "OBJECT", "dict").when(s == "ARRAY", "nested").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").otherwise("number"))
    kinds = F.array_distinct(kind)
    return F.when(F.size(items) == 0, "empty").when((F.size(kinds) == 1) & (kinds[0] != "null"), F.concat(kinds[0], F.lit("_array"))).when(items.isNotNull(), "mixed_array")


def canonical_json(json: Column) -> Column:
    """Row 234: keys in order, no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def field_hash(name: Column) -> Column:
    """Row 234."""
    return F.substring(F.sha2(name, 256), 1, 8)


def prefix_hash(messages: Column, n: int) -> Column:
    """Rows 320, 359: of the first ``n`` of an array of messages."""
    return F.substring(F.sha2(F.to_json(F.slice(messages, 1, n)), 256), 1, 16)


def estimated_cost(tokens_in: Column, tokens_out: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """Row 322: dollars at prices a million tokens; cached ones are among those that go in."""
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1e6


def utc_time(x: Column) -> Column:
    """Rows 324, 325: ISO-8601 with Z, an offset or neither, which is UTC (the session's zone); null else."""
    return F.try_to_timestamp(x)


def general(x: Column, digits: int = 4) -> Column:
    """Row 330: a number with four significant digits, as an exponent below 1e-4 and from 1e4 on, without trailing zeros; ties away from zero."""
    exponent = F.regexp_extract(F.format_string(f"%.{digits - 1}e", x), r"e([+-]\d+)$", 1).cast("int")
    fixed = F.when(exponent < 0, F.format_string("%.7f", F.round(x, 7)))
    for k in range(digits):
        fixed = F.when((exponent == k), F.format_string(f"%.{digits - 1 - k}f", x)).otherwise(fixed)
    for k in range(1, 5):
        fixed = F.when((exponent == -k), F.format_string(f"%.{digits - 1 + k}f", x)).otherwise(fixed)
    strip = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    scientific = F.format_string(f"%.{digits - 1}e", x)
    mantissa = strip(F.regexp_extract(scientific, r"^([^e]+)e", 1))
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= digits), F.concat(mantissa, F.regexp_extract(scientific, r"(e.*)$", 1))).otherwise(strip(fixed))


def primary_command(command: Column) -> Column:
    """Row 313: a shell command without redirections and paging, up to its first pipe or chain."""
    bare = F.trim(F.regexp_replace(command, r"(\s+2>&1|\s+2>/dev/null|\s+\|\s*(head|tail)(\s+-n?\s*\d+)?)+\s*$", ""))
    return F.rtrim(F.regexp_extract(bare, r"^(.*?)( \| | && |$)", 1))


# What a text says that carries an earlier session on.
CONTINUED = "this session is being continued from a previous conversation"
SUMMARISED, RAN_OUT = "conversation is summarized below", ("ran out of context", "previous conversation")
SUMMARY_WORDS, COMPACT, SPEAKS_OF = ("summary", "summarized"), ("/compact", "claude"), ("conversation", "session")


def is_continued_summary(text: Column) -> Column:
    """Row 417: texts that carry an earlier session on as its summary."""
    t = F.regexp_replace(F.lower(text), r"\s+", " ")
    any_of = lambda words: reduce(Column.__or__, [t.contains(w) for w in words])
    summary = any_of(SUMMARY_WORDS)
    command = reduce(Column.__and__, [t.contains(w) for w in COMPACT])
    return F.coalesce((t.contains(CONTINUED) & summary) | (t.contains(SUMMARISED) & any_of(RAN_OUT)) | (command & summary & any_of(SPEAKS_OF)), F.lit(False))


def cache_ttl(explicit: Column, learned: Column, default: int = 300) -> Column:
    """Row 413: an hour or five minutes where a request says so, else what was learnt, else the default."""
    return F.when(F.array_contains(explicit, "1h"), 3600).when(F.array_contains(explicit, "5m"), 300).otherwise(F.coalesce(learned.cast("int"), F.lit(default)))


def known_or_other(label: Column, known: list[str]) -> Column:
    """Row 455."""
    return F.when(label.isin(*known), label).otherwise("other")


def word_statistics(words: Column) -> dict[str, Column]:
    """Row 303: words, different ones, the share of those, words used once, and Yule's K of an array of words."""
    n, v = F.size(words), F.size(F.array_distinct(words))
    long = lambda x: F.lit(x).cast("long")

    def step(s: Column, w: Column) -> Column:
        """Equal words are neighbours: the run of the last one, the sum of squares of all runs, and the runs of one that have ended."""
        same = (s["run"] > 0) & (s["last"] == w)
        ended = F.when(~same & (s["run"] == 1), 1).otherwise(0)
        return F.struct(w.alias("last"), F.when(same, s["run"] + 1).otherwise(long(1)).alias("run"), (s["squares"] + F.when(same, 2 * s["run"] + 1).otherwise(long(1))).alias("squares"), (s["once"] + ended).alias("once"))

    start = F.struct(F.lit("").alias("last"), long(0).alias("run"), long(0).alias("squares"), long(0).alias("once"))
    end = F.aggregate(F.sort_array(words), start, step)
    squares, once = end["squares"], (end["once"] + (end["run"] == 1).cast("long")).cast("int")
    return {"words": n, "different": v, "ratio": F.when(n > 0, v / n).otherwise(0.0), "once": once, "yule_k": F.when(n > 0, 10000 * (squares - n) / (n * n)).otherwise(0.0)}


def structure_counts(text: Column) -> dict[str, Column]:
    """Row 304: how often a prompt has each of some structures."""
    found = {
        "numbered": r"(?m)^[ \t]*\d+[.)][ \t]+", "bullets": r"(?m)^[ \t]*[-*+][ \t]+", "headers": r"(?m)^#+[ \t]+", "inline_code": r"`[^`]+`", "links": r"\[[^\]]+\]\([^)]+\)", "quotes": r"(?m)^[ \t]*>[ \t]+",
        "tags": r"<[^>]+>", "delimiters": r"(?m)^[-=_]{3,}$", "questions": r"\?", "exclamations": "!",
    }
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in found.items()}


def recall_of(facts: Column, kept: Column) -> Column:
    """Row 311: the share of facts that a shorter text still holds; 1 where there are none."""
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: kept.contains(f))) / F.size(facts)).otherwise(1.0)
