"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. One pass finds the distinct pre-tokens of the corpus and how often they occur, summed
   within tasks before the shuffle; the tokenizer then counts the pieces of each once.
2. A second pass reduces every document to its pre-token frequencies.  Those of the
   most frequent pre-tokens, ``HEAD`` of them at most, which are broadcast, are multiplied
   there; the rest go through a join on the pre-token and are summed by document.

The head takes the skew out of the join: no pre-token that is frequent enough to be hot is in
it.  Counts are exact for every text.  Null and empty texts have 0 bytes and 0 tokens; repeated
rows are counted each; a null doc_id is carried through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.llm.bpe import MARK, PreTokens, default_vocabulary, encoder, pre_tokens
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.textual import blocks, cut_long, string_buffers

#: Pre-tokens whose counts are broadcast: at most this many, none of them longer than so many bytes: 7 MB at most.
HEAD, HEAD_BYTES = 100_000, 64


def _cut_up(found: PreTokens, vocabulary: str) -> PreTokens:
    """The same with the opaque pieces cut into the library's pre-tokens."""
    if not any(k.startswith(MARK) for k in found.distinct):
        return found
    cut, names = encoder(vocabulary).cut, {}
    parts = [[names.setdefault(x, len(names)) for x in (cut(k) if k.startswith(MARK) else [k])] for k in found.distinct]
    n = np.array([len(x) for x in parts])
    flat, begin = np.array([i for x in parts for i in x], dtype=np.int64), np.cumsum(n) - n
    own = n[found.number]
    at = np.arange(own.sum()) + np.repeat(begin[found.number] - (np.cumsum(own) - own), own)
    return PreTokens(np.repeat(found.text, own), flat[at], list(names))


def _found(offsets: np.ndarray, data: np.ndarray, vocabulary: str) -> Iterator[tuple[np.ndarray, PreTokens]]:
    """The pre-tokens of some texts at a time, and which text each of their texts is a part of."""
    cuts, owner = cut_long(offsets, data)
    for low, high in blocks(cuts):
        yield owner[low:high], _cut_up(pre_tokens(cuts[low : high + 1], data[cuts[low] : cuts[high]]), vocabulary)


def _distinct(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[bytes, int] = {}
            for _, found in _found(*string_buffers(batch.column("text")), vocabulary):
                for key, n in zip(found.distinct, np.bincount(found.number, minlength=len(found.distinct)).tolist(), strict=True):
                    total[key] = total.get(key, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.binary()), pa.array(list(total.values()), type=pa.int64())], names=["pre_token", "uses"])

    return count


def _pieces(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary).ids
        for batch in batches:
            n = [len(ids(p.as_py())) for p in batch.column("pre_token")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pre_token", "uses")), pa.array(n, type=pa.int64())], names=["pre_token", "uses", "pieces"])

    return count


def _frequencies(head, vocabulary: str):
    """Rows of one document each (pre_token null) with what the head gives, and of its rarer pre-tokens."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = head.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_bytes", "n", "pre_token"]
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            n = len(batch)
            total = np.zeros(n, dtype=np.int64)
            ids = batch.column("doc_id")
            for owner, found in _found(offsets, data, vocabulary):
                if not len(found.number):
                    continue
                pieces = np.array([known.get(k, -1) for k in found.distinct], dtype=np.int64)
                own, text = pieces[found.number], owner[found.text]
                total += np.bincount(text, weights=np.maximum(own, 0), minlength=n).astype(np.int64)
                rare = own < 0
                width = len(found.distinct)
                pairs, uses = np.unique(text[rare] * width + found.number[rare], return_counts=True)
                keys = [found.distinct[i] for i in (pairs % width).tolist()]
                m = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(row + pairs // width), pa.nulls(m, ids.type), pa.array(np.zeros(m, dtype=np.int64)), pa.array(uses), pa.array(keys, type=pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), ids, pa.array(np.diff(offsets)), pa.array(total), pa.nulls(n, pa.binary())], names=names)
            row += n

    return spread


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, head: int = HEAD) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    scratch = Scratch(spark, "token-counts")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distinct = texts.select("text").mapInArrow(_distinct(vocabulary), "pre_token binary, uses long").groupBy("pre_token").agg(F.sum("uses").alias("uses"))
    counted = scratch.save(distinct.mapInArrow(_pieces(vocabulary), "pre_token binary, uses long, pieces long"), "pieces")
    # the rarest of the head by a histogram of the counts, some hundred rows: no task sends more than it has of the head
    short = counted.where(F.octet_length("pre_token") <= HEAD_BYTES)
    steps = short.groupBy(F.floor(F.log2("uses") * 8).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for row in steps:
        taken += row["n"]
        if taken > head:
            break
        least = row["step"]
    top = short.where(F.lit(False) if least is None else F.floor(F.log2("uses") * 8) >= least).select("pre_token", "pieces").toArrow().to_pandas()
    known = {bytes(p): int(n) for p, n in top.itertuples(index=False)}
    spread = scratch.save(texts.mapInArrow(_frequencies(spark.sparkContext.broadcast(known), vocabulary), "row long, doc_id long, n_bytes long, n long, pre_token binary"), "frequencies")
    rare = spread.where("pre_token IS NOT NULL").join(counted.select("pre_token", "pieces"), "pre_token")
    rest = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    out = spread.where("pre_token IS NULL").join(rest, "row", "left")
    tokens = F.col("n") + F.coalesce("rest", F.lit(0))
    return out.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
