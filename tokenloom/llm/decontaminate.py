"""Benchmark passages in documents by greedy string tiling.

A document and a benchmark item that share ``SEED`` words in a row are tiled: the longest common runs of words that
overlap no earlier tile are marked again and again, until none of ``SEED`` words is left.  Runs are found by
Karp-Rabin hashes of ``SEED`` words and extended.  The item's words under tiles, as a share of the item, are its
coverage; passages whose sentences were moved about keep it.  A document is contaminated by items covered to
``COVERAGE`` or more.

Words are runs of bytes outside ASCII white space and marks, A-Z lower-cased.  The benchmark is sent to the tasks in
blocks of at most ``BLOCK_WORDS`` words (some 30 MB there), one pass over the documents each, whatever
its size; documents are never shuffled.  An item of fewer words than a seed has no seed and marks no document.

Defined results: null and empty texts match nothing; repeated rows are reported each, repeated items once an id and text;
null ids are carried through; an empty table on either side gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.textual import MARKS, blocks, string_buffers, windows, words_of

SEED = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
RESULT = "doc_id long, item_id long, coverage double, tiles array<struct<doc_word: int, item_word: int, words: int>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])))])


def tile(text: np.ndarray, pattern: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in pattern, words) of two arrays of word hashes.

    Of common runs that are equally long the first in the pattern, then in the text, is marked.
    """
    starts: dict[int, list[int]] = defaultdict(list)
    keys = windows(pattern, least).tolist()
    for j, key in enumerate(keys):
        starts[key].append(j)
    at = windows(text, least)
    seeds = [(int(i), j) for i in np.flatnonzero(np.isin(at, np.array(keys, dtype=np.uint64))) for j in starts[int(at[i])]]
    used_text, used_pattern = np.zeros(len(text), dtype=bool), np.zeros(len(pattern), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    while seeds:
        matches = []
        done: set[tuple[int, int]] = set()
        for i, j in seeds:
            if (i, j) in done:
                continue  # inside a run that began earlier
            n = 0
            while i + n < len(text) and j + n < len(pattern) and text[i + n] == pattern[j + n] and not used_text[i + n] and not used_pattern[j + n]:
                n += 1
                done.add((i + n, j + n))
            if n >= least:
                matches.append((-n, j, i))
        if not matches:
            break
        longest = min(matches)[0]
        for n, j, i in sorted(m for m in matches if m[0] == longest):
            if not used_text[i : i - n].any() and not used_pattern[j : j - n].any():
                used_text[i : i - n] = used_pattern[j : j - n] = True
                tiles.append((i, j, -n))
        seeds = [(i, j) for i, j in seeds if not used_text[i : i + least].any() and not used_pattern[j : j + least].any()]
    return tiles


class Benchmark:
    """A block of items: word hashes of each, and which items have a seed."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        words = words_of(*string_buffers(pa.array(texts, type=pa.string())), MARKS)
        self.words = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.items: dict[int, set[int]] = defaultdict(set)
        for k, own in enumerate(self.words):
            for key in windows(own, SEED).tolist():
                self.items[key].add(k)
        self.seeds = np.array(sorted(self.items), dtype=np.uint64)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Where ``keys`` are seeds of any item."""
        if not len(self.seeds) or not len(keys):
            return np.zeros(0, dtype=np.int64)
        # the upper 16 bits rule most out before they are looked up
        some = np.zeros(1 << 16, dtype=bool)
        some[(self.seeds >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(some[(keys >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.seeds, keys[maybe])
        return maybe[self.seeds[np.minimum(place, len(self.seeds) - 1)] == keys[maybe]]


def _scan(shared, coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            rows = []
            for low, high in blocks(offsets):
                words = words_of(offsets[low : high + 1], data[offsets[low] : offsets[high]], MARKS)
                keys = windows(words.hashes, SEED)
                found: dict[int, set[int]] = defaultdict(set)
                for i in bench.hits(keys).tolist():
                    if words.text[i] == words.text[i + SEED - 1]:
                        found[int(words.text[i])] |= bench.items[int(keys[i])]
                for t in sorted(found):
                    own = words.hashes[words.first[t] : words.first[t + 1]]
                    for k in sorted(found[t]):
                        tiles = tile(own, bench.words[k])
                        share = sum(n for _, _, n in tiles) / len(bench.words[k])
                        if share >= coverage:
                            rows.append({"doc_id": batch.column("doc_id")[low + t].as_py(), "item_id": bench.ids[k], "coverage": share, "tiles": [{"doc_word": i, "item_word": j, "words": n} for i, j, n in tiles]})
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT_ARROW)

    return scan


def _benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_words`` words; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    sized = items.withColumn("bytes", F.octet_length("text"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // (4 * block_words)))  # a word and its gap are four bytes or more, nearly always
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        rows = (sized if parts == 1 else sized.where(part == p)).orderBy("item_id", "text").select("item_id", "text").toArrow().to_pandas()
        if len(rows):
            yield Benchmark([None if x != x else int(x) for x in rows["item_id"]], rows["text"].tolist())


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, coverage, tiles``: a row for each document and item that it covers."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(_scan(spark.sparkContext.broadcast(b), coverage), RESULT) for b in _benchmark_blocks(benchmark, block_words)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], RESULT)


def _flag(shared, coverage: float):
    inner = _scan(shared, coverage)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), batch.column("text").cast(pa.string())], names=["doc_id", "text"])
            hit = np.zeros(n, dtype=bool)
            for found in inner(iter([numbered])):
                hit[found.column("doc_id").to_numpy()] = True
            yield batch.filter(pa.array(~hit))

    return flag


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text covers an item; all columns as they were."""
    for b in _benchmark_blocks(benchmark, block_words):
        docs = docs.mapInArrow(_flag(docs.sparkSession.sparkContext.broadcast(b), coverage), docs.schema)
    return docs
