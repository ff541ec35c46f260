"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations make all signature coordinates (``minhash``), bands of them make buckets,
and ``linking`` confirms candidates on full shingle sets.

Defined results: words are runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; a text with
fewer words than a shingle has one shingle, the whole sequence; null and empty texts have
none and link with nothing.  Rows with equal sets are one class, so exact copies and
repeated rows cost one partial aggregate.  A row without doc_id is reported with a null
component and links with nothing.  An empty table gives no rows.  Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.linking import link
from tokenloom.llm.minhash import band_keys, signatures
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.textual import blocks, distinct_per_text, shingles, string_buffers, words_of

#: 24 bands of 4 rows: at similarity 0.85 a pair shares no band once in 5e7, at 0.8 once in 3e5.
BANDS, ROWS = 24, 4


def _class_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each block of texts, where it begins and its sorted shingle sets."""
    offsets, data = string_buffers(texts)
    for low, high in blocks(offsets):
        cut = offsets[low : high + 1]
        yield low, distinct_per_text(*shingles(words_of(cut, data[cut[0] : cut[-1]]), k))


def _profile(k: int, bands: int, rows: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in _sets(batch.column("text"), k):
                n = np.array([len(x) for x in sets], dtype=np.int64)
                some = np.flatnonzero(n)
                keys: list[np.ndarray | None] = [None] * len(sets)
                if len(some):
                    first = np.concatenate([[0], np.cumsum(n[some])])
                    for t, row in zip(some, band_keys(signatures(np.concatenate([sets[t] for t in some]), first, bands * rows), bands, rows), strict=True):
                        keys[t] = row
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(sets)), pa.array(n), pa.array([_class_id(x) if len(x) else None for x in sets], type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))], names=["doc_id", "n", "cid", "keys"])

    return profile


def _full_sets(k: int, bands: int, rows: int):
    """Rows (doc_id, text, cid) -> the class's set, where the text is that of the class."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("cid")
            for low, sets in _sets(batch.column("text"), k):
                own = [i for i, x in enumerate(sets) if len(x) and _class_id(x) == asked[low + i].as_py()]
                if own:
                    n = np.array([len(sets[i]) for i in own], dtype=np.int64)
                    first = np.concatenate([[0], np.cumsum(n)])
                    sig = signatures(np.concatenate([sets[i] for i in own]), first, bands * rows).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([asked.slice(low, len(sets)).take(pa.array(own)), pa.array(n), pa.array([x.tobytes() for x in sig], type=pa.binary()), pa.array([sets[i].tobytes() for i in own], type=pa.binary())], names=["cid", "n", "sig", "shingles"])

    return full


def near_duplicates(docs: DataFrame, words: int = 5, ratio: tuple[int, int] = (4, 5), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``ratio`` or
    more are linked; a component is named by its least doc_id, and that document is kept.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = scratch.save(texts.mapInArrow(_profile(words, bands, rows), "doc_id long, n long, cid binary, keys array<long>"), "profiles")
    known = profiles.where("doc_id IS NOT NULL AND cid IS NOT NULL")
    classes = scratch.save(known.groupBy("cid").agg(F.min(F.struct("doc_id", "n", "keys")).alias("r")).select("cid", "r.doc_id", "r.n", "r.keys"), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        owners = wanted.join(classes.select("cid", "doc_id"), "cid")
        return owners.join(texts, "doc_id").select("text", "cid").mapInArrow(_full_sets(words, bands, rows), "cid binary, n long, sig binary, shingles binary").dropDuplicates(["cid"])

    roots = link(classes.select("cid", "keys"), sets_of, ratio, scratch).withColumnRenamed("id", "cid")
    named = classes.select("cid", "doc_id").join(roots, "cid", "left").select("cid", "doc_id", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "root").select("cid", "component_id")
    out = profiles.select("doc_id", "n", "cid").join(names, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
