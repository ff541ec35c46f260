"""Text measures and rewrites (inventory rows 22, 98, 220, 239, 250, 259, 262, 271, 288, 289, 297, 298, 302, 308, 314, 319, 321)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts in which a character is about a token.
DENSE = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}]"
# What counts as waste in a text, and what is told as an address, an id, a tag or encoded bytes.
URL = r"https?://\S+"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HTML_TAG = r"<[^>]+>"
HTML_COMMENT = r"(?s)<!--.*?-->"
BASE64 = r"[A-Za-z0-9+/]{50,}={0,2}"
BLANKS = r"[ \t]{4,}|\n{3,}"
#: Words that mark failures in any content.
ERROR_WORDS = ("error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected")


def count(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def token_estimate(text: Column, ratio: float = 4.0) -> Column:
    """Row 289: characters of dense scripts count one each, others ``ratio`` to a token; 0 for null and empty, else 1 at least."""
    dense = count(text, DENSE)
    estimate = F.floor((F.length(text) - dense) / F.lit(ratio) + dense + F.lit(0.5)).cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), estimate))


def matched(text: Column, pattern: str, between: str = "") -> Column:
    """All matches of ``pattern`` in one string."""
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between)


def waste_signals(text: Column) -> dict[str, Column]:
    """Row 98: tokens of markup, of base64 runs, and those that single blanks would save."""
    html = F.concat(matched(text, HTML_TAG), matched(text, HTML_COMMENT))
    blanks = token_estimate(matched(text, BLANKS)) - token_estimate(matched(text, BLANKS, " "))
    return {"html_noise": token_estimate(html), "base64": token_estimate(matched(text, BASE64)), "whitespace": F.greatest(F.lit(0).cast("long"), blanks)}


def strip_ansi(text: Column) -> Column:
    """Row 239."""
    return F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")


def log_shape(line: Column) -> Column:
    """Row 250: what is left of a log line when numbers, hex and paths are masked, up to the first colon or equals sign."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"0x[0-9a-fA-F]+", "<hex>"), r"(/[\w.-]+)+", "<path>"), r"\d+", "<n>")
    return F.regexp_extract(masked, r"^[^:=]*", 0)


def log_level(line: Column) -> Column:
    """Row 22: the gravest level named in a line."""
    out = F.lit("unknown")
    for level, words in (("trace", "TRACE"), ("debug", "DEBUG"), ("info", "INFO"), ("warn", "WARN|WARNING"), ("fail", "FAIL|FAILED"), ("error", "ERROR|FATAL|CRITICAL")):
        out = F.when(line.rlike(rf"\b({words})\b"), level).otherwise(out)
    return out


def has_error_word(text: Column) -> Column:
    """Rows 220 and 271."""
    return F.coalesce(F.lower(text).rlike("|".join(ERROR_WORDS)), F.lit(False))


def volatile_counts(text: Column) -> dict[str, Column]:
    """Row 297: tokens that change from run to run."""
    return {"uuids": count(text, UUID), "iso_dates": count(text, r"\d{4}-\d{2}-\d{2}"), "hex_ids": count(text, r"\b[0-9a-f]{32,}\b"), "urls": count(text, URL), "emails": count(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "ips": count(text, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")}


def alignment_score(findings: Column) -> Column:
    """Row 298: 100 less 10 for each finding, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), F.lit(100).cast("long") - F.lit(10).cast("long") * findings.cast("long"))


def redact(text: Column) -> Column:
    """Row 302: keys, tokens and long base64 runs by placeholders."""
    hidden = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[:=]\s*)\S+", "$1$2<redacted>")
    hidden = F.regexp_replace(hidden, r"\b(sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}", "<redacted>")
    return F.regexp_replace(hidden, BASE64, "<base64>")


def words(text: Column) -> Column:
    """Rows 262 and 288: lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """Rows 288 and 308: runs of ``n`` neighbouring items, joined by blanks; none for shorter arrays."""
    run = lambda own, i: F.array_join(F.slice(own, i, n), " ")
    every = lambda own: F.when(F.size(own) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1))), lambda i: run(own, i)))
    return F.transform(F.array(items), every)[0]  # the items are made once, not for each run


def keyword_density(text: Column) -> Column:
    """Row 259: tokens with a digit, of capitals or with dots, as a share of the words and one."""
    salient = count(text, r"\b(?:\w*\d\w*|[A-Z]{2,}|\w+\.\w+)\b")
    return salient / (F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")) + 1)


def error_class(text: Column) -> Column:
    """Row 314: the first kind of failure whose words appear."""
    low, out = F.lower(text), F.lit("other")
    for kind, pattern in (("syntax", "syntaxerror|parse error"), ("permission", "permission denied|forbidden|eacces"), ("timeout", "timed? ?out"), ("not_found", "no such file|not found|enoent|404")):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def short_hash(text: Column, length: int = 16) -> Column:
    """Row 319."""
    return F.substring(F.md5(text), 1, length)


def anonymise_query(text: Column) -> Column:
    """Row 321: ``field:value`` as ``field:*``."""
    return F.regexp_replace(text, r"(\w+):\S+", "$1:*")
