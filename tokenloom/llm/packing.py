"""Best-fit packing of token sequences by large-item matching.

Pieces longer than a third of the capacity go at most two to a bin, so they are matched greedily: the
longest with the longest other that still fits.  The smaller ones, longest first, then go into the
tightest gap that takes them.

Both need only how many pieces have each length.  That histogram has at most ``capacity`` rows for any
corpus, so the plan is made on the driver in runs: a run is so many bins of one pattern of lengths.  The
pieces then find their place by joining their rank within their length to the runs.  A length that a third of all
pieces share is ranked by task: each task counts its pieces and adds the counts of the tasks before it.

Null text is empty; every document has its end id, so an empty one is a piece of one id.  Documents longer than
the capacity are cut into full pieces and a last one.  Repeated rows are packed each; a null doc_id is carried
through; an empty table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.llm.bpe import default_vocabulary, encoder
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.textual import string_buffers
from tokenloom.llm.token_files import ids_and_texts, row_encoder

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, turn long"


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs ``(bins, lengths in a bin)`` that hold ``histogram[length]`` pieces of each length.

    Every step uses up a length or a kind of bin, so the number of steps depends on the
    capacity and not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    #: Bins by the gap that is left in them.
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a:
            pairs, alone = divmod(left[a], 2)
            if pairs:
                open_bins[capacity - 2 * a].append((pairs, (a, a)))
            left[a] = alone
            if alone:  # the odd one takes the next longest that fits, or stays alone
                b = large[at - 1] if at >= 1 else 0
        if b and b != a:
            n = min(left[a], left[b])
            if n:
                open_bins[capacity - a - b].append((n, (a, b)))
            left[a] -= n
            left[b] -= n
            if not left[b]:
                large.remove(b)
        elif left[a]:
            open_bins[capacity - a].append((left[a], (a,)))
            left[a] = 0
        if not left[a]:
            large.remove(a)
    gaps = sorted(open_bins)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                full, rest = divmod(count, each)
                for bins, k in ((full, each), (1, rest)):
                    if bins and k:
                        gap = capacity - k * n
                        if not open_bins[gap]:
                            bisect.insort(gaps, gap)
                        open_bins[gap].append((bins, (n,) * k))
                break
            gap = gaps[at]
            bins, inside = open_bins[gap].pop()
            if not open_bins[gap]:
                del gaps[at]
            # best fit puts one piece after another into the tightest gap: as many as fit into one bin, then the next
            each = gap // n
            full = min(bins, count // each)
            rest = min(count - full * each, each - 1) if full < bins else 0
            for m, k in ((full, each), (1 if rest else 0, rest)):
                if m:
                    if not open_bins[gap - k * n]:
                        bisect.insort(gaps, gap - k * n)
                    open_bins[gap - k * n].append((m, inside + (n,) * k))
            kept = bins - full - (1 if rest else 0)
            if kept:
                if not open_bins[gap]:
                    bisect.insort(gaps, gap)
                open_bins[gap].append((kept, inside))
            count -= full * each + rest
    return [run for gap in sorted(open_bins) for run in open_bins[gap]]


def _pieces(capacity: int, width: int):
    """Rows (doc_id, ids) -> the pieces, numbered by their turn among those of their length in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            offsets, data = string_buffers(batch.column("ids"))
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                ids = data[a:b].view(f"<u{width}")
                for p, low in enumerate(range(0, len(ids), capacity)):
                    own = ids[low : low + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(low)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            n = np.array(length, dtype=np.int64)
            turn = seen[n] + pd.Series(n).groupby(n).cumcount().to_numpy() if len(n) else n
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(n.astype(np.int32)), pa.array(crc, type=pa.int64()), pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(turn)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "turn"],
            )

    return cut


def _places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks where a new slot begins, the first sequence of the slot's run, the offset in it."""
    ranks: dict[int, int] = defaultdict(int)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for bins, inside in runs:
        offset = 0
        for n in inside:
            slots[n].append((ranks[n], first, offset))
            ranks[n] += bins
            offset += n
        first += bins
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}


def _assign(plan):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = plan.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("turn").to_numpy() + batch.column("earlier").to_numpy()
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                own = n == length
                begin, first, at = places[int(length)]
                slot = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own] = first[slot] + rank[own] - begin[slot]
                offset[own] = at[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(n.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return assign


def pack(docs: DataFrame, capacity: int = 4096, end: int = 1, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    scratch = Scratch(spark, "packing")
    width = encoder(vocabulary).dtype.itemsize
    encode, cut = row_encoder(vocabulary, end), _pieces(capacity, width)
    # both in one worker: a second one a task would stay idle with memory of its own
    pieces = scratch.save(ids_and_texts(docs).mapInArrow(lambda batches: cut(encode(batches)), PIECE), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most one row a task for each length, whatever the number of pieces
    earlier = by_task.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("length", "task", "earlier")
    plan = spark.sparkContext.broadcast(_places(pack_lengths(histogram, capacity)))
    placed = pieces.join(earlier, ["length", "task"])
    return placed.mapInArrow(_assign(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
