"""Rates by steps put together against one event after another."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import rates as R

SCHEMA = "tool string, strategy string, at long, id long, kind string, key string, move int"


def made():
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), rng.randrange(200), i, rng.choice(["compress"] * 6 + ["retrieve", "full", "other", None]), "k", 1) for i in range(1500)]
    return [*rows, ("c", "x", 1, 9000, "full", "k", 1), ("d", "x", 1, 9001, "full", "k", 1), ("d", "x", 2, 9002, "compress", "k", 1)]


def plain(rows):
    out = {}
    for tool, strategy, _, _, kind, *_ in sorted(rows, key=lambda r: (r[2], r[3])):
        own = (tool, strategy)
        if own not in out:
            if kind == "compress":
                out[own] = 1.0
        else:
            out[own] = min(1.0, max(0.0, out[own] + R.MOVES.get(kind, 0.0)))
    return {k: round(v, 9) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 2, 40, None])
def test_rates(spark, parts):
    events = spark.createDataFrame(made(), SCHEMA).repartition(5)
    got = R.strategy_rates(events, ["tool"], "strategy", "at", "id", F.col("kind"), parts)
    assert {(r.tool, r.strategy): round(r.rate, 9) for r in got.collect()} == plain(made())
    best = {r.tool: r.best for r in R.best_strategies(got, ["tool"], "strategy").collect()}
    assert best["d"] == "x" and set(best) == {"a", "b", "d", None}
    assert R.strategy_rates(events.limit(0), ["tool"], "strategy", "at", "id", F.col("kind")).count() == 0
