"""Rates that every event moves a little and that stay between 0 and 1 (inventory rows 121, 122).

A step takes x to min(high, max(low, x + shift)).  Steps in a row are again one such step, so events are sorted by ranges, each task makes one step of its
events of a key, and the few steps of a key are put together in order: the result is that of one event after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.cluster import ship

#: What a compression adds to its strategy's rate, and what fetching a part or all of it back takes off.
MOVES = {"compress": 0.02, "retrieve": -0.05, "full": -0.15}


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One step for each run of a key in the task."""
    task, key, step, rows = TaskContext.get().partitionId(), None, (0.0, 0.0, 1.0), []
    for batch in batches:
        for own, move in zip(batch.column("key").to_pylist(), batch.column("move").to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    rows.append((key, task, *step))
                key, step = own, (0.0, 0.0, 1.0)
            shift, low, high = step
            step = (shift + move, min(1.0, max(0.0, low + move)), min(1.0, max(0.0, high + move)))
    if key is not None:
        rows.append((key, task, *step))
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["key", "task", "shift", "low", "high"])


def strategy_rates(events: DataFrame, by: list[str], strategy: str, at: str, tie: str, kind: Column, parts: int | None = None) -> DataFrame:
    """``by, strategy, rate`` after all events in order of (at, tie): 1 with the first compression, moved by each event after it.

    ``kind`` is compress, retrieve or full; other kinds and null move nothing.  A strategy that never compressed has no rate and no row.
    """
    ship(events.sparkSession)
    move = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MOVES.items() for x in pair]), kind), F.lit(0.0))
    own = [*by, strategy]
    named = events.select(F.to_json(F.struct(*own)).alias("key"), F.struct(at, tie).alias("o"), move.alias("move"), (kind == "compress").alias("begins"), *own)
    first = named.groupBy("key").agg(F.min(F.when(F.col("begins"), F.col("o"))).alias("first"), *[F.first(c).alias(c) for c in own]).where("first IS NOT NULL")
    moves = named.select("key", "o", "move").join(first.select("key", "first"), "key").where(F.col("o") > F.col("first")).select("key", "o", "move")
    dealt = moves.repartitionByRange(parts, "key", "o") if parts else moves.repartitionByRange("key", "o")
    steps = dealt.sortWithinPartitions("key", "o").select("key", "move").mapInArrow(_steps, "key string, task int, shift double, low double, high double")
    inside = F.sort_array(F.collect_list(F.struct("task", "shift", "low", "high")))
    ends = steps.groupBy("key").agg(F.aggregate(inside, F.lit(1.0), lambda x, s: F.least(s["high"], F.greatest(s["low"], x + s["shift"]))).alias("rate"))
    return first.join(ends, "key", "left").select(*own, F.coalesce("rate", F.lit(1.0)).alias("rate"))


def best_strategies(rates: DataFrame, by: list[str], strategy: str) -> DataFrame:
    """Row 123: the strategy of the highest rate; ties go to the first name."""
    best = F.min_by(strategy, F.struct((-F.round("rate", 9)).alias("r"), F.col(strategy).alias("s")))
    return rates.groupBy(*by).agg(best.alias("best"), F.max("rate").alias("rate"))
