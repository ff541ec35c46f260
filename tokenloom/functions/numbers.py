"""Arithmetic rules (inventory rows 57, 59, 124, 165, 166, 170, 180, 287, 294, 329, 362, 468)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def net_gain(saved: Column, suffix: Column, reads: float, alive: Column | float, write: float = 1.25, read: float = 0.1) -> Column:
    """Row 57: what rewriting a cached prefix gains: saved tokens over all reads, less the loss of the live suffix."""
    alive = F.lit(alive) if isinstance(alive, float) else alive
    return saved * F.lit(write + read * (reads - 1)) - alive * F.lit(write - read) * (suffix + saved)


def break_even_reads(saved: Column, suffix: Column, write: float = 1.25, read: float = 0.1) -> Column:
    """Row 59; null where nothing is saved."""
    return F.when(saved > 0, F.lit((write - read) / read) * suffix / saved)


def input_bucket(tokens: Column) -> Column:
    """Row 170."""
    return F.when(tokens < 2000, "xs").when(tokens < 8000, "s").when(tokens < 32000, "m").when(tokens < 128000, "l").otherwise("xl")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Row 329: 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, digits))


def decayed(importance: Column, age_days: Column, accesses: Column, rate: float = 0.01) -> Column:
    """Row 166: exponential decay with a bonus for use, 0.3 at most."""
    return importance * F.exp(-F.lit(rate) * age_days) + F.least(F.lit(0.3), F.lit(0.05) * accesses)


def recency(score: Column, age_days: Column, scale: float = 30.0) -> Column:
    """Row 165: an unknown or future time weighs 1."""
    return score * F.when(age_days.isNull() | (age_days < 0), F.lit(1.0)).otherwise(F.exp(-age_days / F.lit(scale)))


def cached_prefix(tokens: Column) -> Column:
    """Row 362: whole blocks of 128 tokens from 1024 on."""
    return F.when(tokens < 1024, F.lit(0)).otherwise(F.floor(tokens / 128) * 128).cast("long")


def holdout_arm(key: Column, fraction: float) -> Column:
    """Row 468: by the first eight hex digits of a hash, so that a key keeps its arm."""
    if fraction <= 0 or fraction >= 1:
        return F.lit("treatment" if fraction <= 0 else "control")
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit("arm:"), key), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295)
    return F.when(unit < fraction, "control").otherwise("treatment")


def confidence(samples: Column, users: Column) -> Column:
    """Row 124."""
    return F.least(F.lit(0.95), F.least(F.lit(0.7), samples / 100.0) + F.least(F.lit(0.3), F.lit(0.03) * users))


def k_split(k: Column) -> tuple[Column, Column, Column]:
    """Row 180: how many of k come from the front, the back and by importance; halves round to even."""
    front = F.greatest(F.lit(1), F.bround(k * F.lit(0.3)).cast("int"))
    back = F.greatest(F.lit(1), F.bround(k * F.lit(0.15)).cast("int"))
    return front, back, F.greatest(F.lit(0), k - front - back)


def hamming(a: Column, b: Column) -> Column:
    """Row 287."""
    return F.bit_count(a.bitwiseXOR(b))


def image_tokens(width: Column, height: Column) -> Column:
    """Row 294."""
    return F.ceil(width * height / 750).cast("long")
