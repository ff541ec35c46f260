"""Repeated paragraphs and passages: paragraph MinHash, exact Jaccard, components; anchored pieces inside paragraphs.

Paragraphs are lines of at least ``LEAST`` words.  Twelve bands of three MinHash values of their five-word shingles (a pair at
similarity 0.8 shares none once in 5,500) make buckets, and ``linking`` confirms the colliding ones on exact Jaccard
similarity and joins them into components.  Of a component's occurrences the first by (doc_id, place) stays.

A passage inside longer paragraphs makes none of them similar.  So lines are also cut into pieces wherever the hash of
two neighbouring words is the least within three words on either side: the same words are cut alike wherever they
stand.  Pieces that occur elsewhere are duplicates, the first occurrence apart, and a run of them that has
``LEAST`` words or more is a repeated passage.  Some seven words at either end of a passage may not be in whole pieces, so
repeats of over 50 words are found whatever surrounds them, but for about one in a hundred with unlucky cuts.

Nothing here shuffles texts.  Defined results: null and empty texts have no paragraphs; rows without doc_id are left alone;
equal rows are one occurrence; rows of one doc_id with different texts are different places; an empty table gives
no rows.  Columns other than doc_id and text are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.linking import link
from tokenloom.llm.membership import bloom, maybe_in
from tokenloom.llm.minhash import band_keys, signatures
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.textual import Words, blocks, mix, string_buffers, windows, words_of

#: Words of a paragraph, or of a stretch of pieces, from which a repeat counts.
LEAST = 27
SHINGLE, BANDS, ROWS = 5, 12, 3
#: Words on either side among which a cut has the least hash.
REACH = 3
#: Columns that stand beside the documents' own for a while.
CUTS, OWNER = "_tokenloom_cuts", "_tokenloom_owner"
#: A place is 24 bits of the text's hash, then the byte where it begins.
PLACE_BITS = 39


def _tags(words: Words) -> np.ndarray:
    """The hash of each text above the place bits."""
    n = len(words.offsets) - 1
    weights = words.hashes * (np.arange(len(words.hashes), dtype=np.uint64) - np.repeat(words.first[:-1], np.diff(words.first)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(weights), dtype=np.uint64)])
    return ((mix(total[words.first[1:]] - total[words.first[:-1]]) >> np.uint64(40)) << np.uint64(PLACE_BITS)).astype(np.int64).reshape(n)


def _cuts(words: Words, inside: bool) -> np.ndarray:
    """The words that begin a line, or with ``inside`` also a piece of one."""
    n = len(words.hashes)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    begins = np.ones(n, dtype=bool)
    begins[1:] = (lines[words.start[1:]] != lines[words.start[:-1]]) | (words.text[1:] != words.text[:-1])
    if inside and n > 2 * REACH + 1:
        pair = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
        own = pair[REACH : n + REACH]
        own[1:] = mix(words.hashes[1:] * np.uint64(3) + words.hashes[:-1])
        least = np.ones(n, dtype=bool)
        for d in range(1, REACH + 1):
            least &= (own < pair[REACH - d : n + REACH - d]) & (own <= pair[REACH + d : n + REACH + d])
        begins |= least
    return np.flatnonzero(begins)


def _sequence_ids(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the words in each span, by their places in it."""
    size = last - first
    end = np.cumsum(size)
    begin = end - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    words = hashes[place + np.repeat(first, size)]
    out = np.empty((len(first), 2), dtype=np.uint64)
    for k, odd in enumerate((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + (place + 1).astype(np.uint64) * np.uint64(odd)), dtype=np.uint64)])
        out[:, k] = mix(total[end] - total[begin] + size.astype(np.uint64))
    return out


class _Spans:
    """Lines or pieces of a block of texts."""

    def __init__(self, words: Words, inside: bool, least: int = 1):
        first = _cuts(words, inside)
        last = np.append(first[1:], len(words.hashes))
        if least > 1:
            kept = last - first >= least
            first, last = first[kept], last[kept]
        self.words, self.first, self.last = words, first, last
        self.text = words.text[first]
        base = words.offsets[self.text]
        self.low = words.start[first] - base
        # a span runs up to the next word, so that neighbours touch
        following = np.append(words.start, len(words.data))[last]
        self.high = np.minimum(following, words.offsets[self.text + 1]) - base
        self.size = last - first

    def ids(self) -> np.ndarray:
        return _sequence_ids(self.words.hashes, self.first, self.last)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of every span in order, and where each span's begin; spans have a shingle at least."""
        counts = self.size - SHINGLE + 1
        begin = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(begin[-1]) + np.repeat(self.first - begin[:-1], counts)
        return windows(self.words.hashes, SHINGLE)[at], begin


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    for batch in batches:
        offsets, data = string_buffers(batch.column("text"))
        for low, high in blocks(offsets):
            words = words_of(offsets[low : high + 1], data[offsets[low] : offsets[high]])
            if len(words.hashes):
                yield batch.column("doc_id").slice(low, high - low), words


def _binary(ids: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids).tobytes())]).cast(pa.binary())


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, words in _each(batches):
        spans = _Spans(words, False, LEAST)
        if len(spans.first):
            keys = band_keys(signatures(*spans.shingles(), BANDS * ROWS), BANDS, ROWS)
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(spans.text)), pa.array(_tags(words)[spans.text] + spans.low), pa.array((spans.high - spans.low).astype(np.int32)), pa.array(spans.size.astype(np.int32)), _binary(spans.ids()), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))],
                names=["doc_id", "place", "bytes", "words", "cid", "keys"],
            )


PARAGRAPH = "doc_id long, place long, bytes int, words int, cid binary, keys array<long>"


def _paragraph_sets(table):
    """The shingle sets of paragraphs that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _each(batches):
            spans = _Spans(words, False, LEAST)
            ids = spans.ids()
            wanted = np.flatnonzero(maybe_in(table.value, ids))
            if len(wanted):
                spans.first, spans.last, spans.size = spans.first[wanted], spans.last[wanted], spans.size[wanted]
                values, begin = spans.shingles()
                sets = [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                sig = signatures(values, begin, BANDS * ROWS).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([_binary(ids[wanted]), pa.array([len(x) for x in sets], type=pa.int64()), pa.array([x.tobytes() for x in sig], type=pa.binary()), pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["cid", "n", "sig", "shingles"])

    return run


def _stretches(words: Words) -> tuple[_Spans, np.ndarray]:
    """For each piece the fewest pieces from it on that have ``LEAST`` words together, where its text has so many, and an id of their words."""
    spans = _Spans(words, True)
    pieces = spans.ids()[:, 0]
    ends = np.searchsorted(spans.last, spans.first + LEAST)
    kept = np.flatnonzero(ends < len(spans.last))
    kept = kept[spans.text[ends[kept]] == spans.text[kept]]
    ends = ends[kept]
    ids = np.zeros(len(kept), dtype=np.uint64)
    for d in range(int((ends - kept).max()) + 1 if len(kept) else 0):
        live = kept + d <= ends
        ids[live] = mix(ids[live] * np.uint64(0xD6E8FEB86659FD93) + pieces[kept[live] + d])
    spans.high, spans.last = spans.high[ends], spans.last[ends]
    spans.first, spans.text, spans.low = spans.first[kept], spans.text[kept], spans.low[kept]
    spans.size = spans.last - spans.first
    return spans, ids.view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, words in _each(batches):
        spans, ids = _stretches(words)
        # words before the stretch: what overlapping ones have together is a difference
        at = spans.first - words.first[spans.text]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), doc_id.take(pa.array(spans.text)), pa.array(_tags(words)[spans.text] + spans.low), pa.array((spans.high - spans.low).astype(np.int32)), pa.array(spans.size.astype(np.int32)), pa.array(at.astype(np.int32))],
            names=["piece", "doc_id", "place", "bytes", "words", "at"],
        )


def _piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each block of texts, one once with whether the block repeats it."""
    for _, words in _each(batches):
        ids, n = np.unique(_stretches(words)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["piece", "n"])


def repeated_paragraphs(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, place, bytes, words, component_id, removed`` of paragraphs that are in a component of several."""
    found = scratch.save(texts.mapInArrow(_paragraphs, PARAGRAPH), "paragraphs")
    classes = scratch.save(found.groupBy("cid").agg(F.first("keys").alias("keys")), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        table = texts.sparkSession.sparkContext.broadcast(bloom(wanted))
        made = texts.mapInArrow(_paragraph_sets(table), "cid binary, n long, sig binary, shingles binary").dropDuplicates(["cid"])
        return made.join(wanted, "cid", "left_semi")

    roots = link(classes, sets_of, (4, 5), scratch).withColumnRenamed("id", "cid")
    placed = found.drop("keys").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).drop("cid")
    heads = placed.groupBy("root").agg(F.min(F.struct("doc_id", "place")).alias("head"), F.max(F.struct("doc_id", "place")).alias("tail")).where("head != tail").select("root", "head")
    out = placed.join(heads, "root")
    removed = (F.col("doc_id") != F.col("head.doc_id")) | (F.col("place") != F.col("head.place"))
    return out.select("doc_id", "place", "bytes", "words", F.col("head.doc_id").alias("component_id"), removed.alias("removed"))


def repeated_passages(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same columns for runs of overlapping stretches, each of which occurs in several places."""
    counts = texts.mapInArrow(_piece_ids, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    twice = counts.where("n > 1").select("piece")
    shared = scratch.save(texts.mapInArrow(_pieces, "piece long, doc_id long, place long, bytes int, words int, at int").join(twice, "piece"), "shared-pieces")
    heads = shared.groupBy("piece").agg(F.min(F.struct("doc_id", "place")).alias("head"), F.max(F.struct("doc_id", "place")).alias("tail")).where("head != tail").select("piece", "head")
    flagged = shared.join(heads, "piece").withColumn("removed", (F.col("doc_id") != F.col("head.doc_id")) | (F.col("place") != F.col("head.place")))
    flagged = flagged.select("doc_id", "place", "bytes", "words", "at", F.col("head.doc_id").alias("first"), "removed")
    one = Window.partitionBy("doc_id", F.shiftright("place", PLACE_BITS), "removed").orderBy("place")
    end = F.max(F.col("place") + F.col("bytes")).over(one.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.coalesce(end < F.col("place"), F.lit(True))
    runs = flagged.withColumn("broken", broken.cast("int")).withColumn("run", F.sum("broken").over(one))
    spans = runs.groupBy("doc_id", F.shiftright("place", PLACE_BITS).alias("tag"), "removed", "run").agg(
        F.min("place").alias("place"), (F.max(F.col("place") + F.col("bytes")) - F.min("place")).cast("int").alias("bytes"), (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("int").alias("words"), F.min("first").alias("component_id")
    )
    return spans.select("doc_id", "place", "bytes", "words", "component_id", "removed")


def repeats(docs: DataFrame) -> DataFrame:
    """Every repeated paragraph and passage: ``doc_id, tag, start, end, words, kind, component_id, removed``.

    start and end are bytes of the UTF-8 text; tag tells texts of one doc_id apart; component_id is the
    doc_id of the first occurrence, which isn't removed.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "passages")
    both = repeated_paragraphs(texts, scratch).withColumn("kind", F.lit("paragraph")).union(repeated_passages(texts, scratch).withColumn("kind", F.lit("passage")))
    start = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    return both.select("doc_id", F.shiftright("place", PLACE_BITS).alias("tag"), start.alias("start"), (start + F.col("bytes")).alias("end"), "words", "kind", "component_id", "removed")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans that belong to a row's text out of it, whole bytes between words."""
    for batch in batches:
        offsets, data = string_buffers(batch.column("text").cast(pa.string()))
        cut = batch.column(CUTS)
        texts: list[str | None] = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if not cut[i].is_valid:
                texts.append(batch.column("text")[i].as_py())
                continue
            own = data[a:b]
            tag = int(_tags(words_of(np.array([0, b - a]), own))[0]) >> PLACE_BITS
            keep = np.ones(b - a, dtype=bool)
            for span in cut[i].as_py():
                if span["tag"] == tag:
                    keep[span["start"] : span["end"]] = False
            texts.append(own[keep].tobytes().decode())
        names = [n for n in batch.schema.names if n != CUTS]
        yield pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string()) if n == "text" else batch.column(n) for n in names], names=names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all but the first occurrence of repeated paragraphs and passages taken out of ``text``; every row stays."""
    spans = repeats(docs).where("removed")
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "end")).alias(CUTS)).withColumnRenamed("doc_id", OWNER)
    joined = docs.join(cuts, docs["doc_id"].cast("long") == F.col(OWNER), "left").drop(OWNER)
    return joined.mapInArrow(_without, docs.schema)
