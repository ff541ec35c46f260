"""Nearest vectors and best texts of a stated set of queries, and a cache asked by meaning (inventory rows 81, 82, 187, 188, 260, 265, 358).

Exact search reads vectors once for ``QUERY_BLOCK`` queries: these are broadcast, multiplied with Arrow batches of vectors in tiles, and a task gives the best
of its vectors for each query, so that what is shuffled are tasks x queries x k rows whatever the table's size.

Hybrid search leaves no document out before the two scores are added: documents, as counts of the queries' terms, meet their vectors by id, and
a task adds the scores of all its pairs before it gives its best.

Approximate search hashes unit vectors by the signs of random projections, in several tables.  A bucket of over ``CROWD`` vectors is
split by more signs; the rest meet their queries by equijoin, and every candidate is compared exactly.  Equal vectors are one
class, so copies don't fill buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.cluster import shared_folder, ship
from tokenloom.functions.text import words

#: Queries that are broadcast at once, 8 bytes a dimension each, and those multiplied at once.
QUERY_BLOCK, TILE = 65_536, 2048
#: Digits to which similarities are told apart, so that equal vectors tie.
DIGITS = 12
#: Stands for a null id, so that it comes after all others.
NO_ID = np.iinfo(np.int64).max
#: Random projections: tables, signs at most, signs more for a crowded bucket, vectors of a bucket at most before it is split.
TABLES, SIGNS, STEP, CROWD = 24, 24, 3, 1024
_SEED = 64
K1, B = 1.5, 0.75


def _rows(column: pa.Array) -> np.ndarray:
    """An array column as a matrix."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Best:
    """The k best of what is offered for each of some queries; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, low: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``low`` on, a column for each id."""
        high = low + len(score)
        every = np.concatenate([self.score[low:high], score], axis=1)
        own = np.concatenate([self.id[low:high], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((own, -every), axis=1)[:, : self.k]
        self.score[low:high], self.id[low:high] = np.take_along_axis(every, order, 1), np.take_along_axis(own, order, 1)

    def rows(self, queries: np.ndarray, names: list[str]) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(queries[at]), pa.array(self.id[at, place]), pa.array(self.score[at, place])], names=names)


def best(rows: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _scan(queries, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = queries.value
        found = Best(len(ids), k)
        for batch in batches:
            own, vectors = batch.column("vec_id").to_numpy(), _unit(_rows(batch.column("embedding"))).T
            for low in range(0, len(ids), TILE):
                score = np.round(unit[low : low + TILE] @ vectors, DIGITS)
                score[(score < least) | (ids[low : low + TILE, None] == own)] = -np.inf
                found.offer(low, score, own)
        yield found.rows(ids, ["query_id", "vec_id", "similarity"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows 81 and 187: ``query_id, vec_id, similarity, rank``: the k most similar other vectors of each query, none below ``least``.

    ``vectors(vec_id, embedding)`` and ``queries`` alike; rows without id or vector take no part; a vector of zeros has similarity 0.
    """
    ship(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    whole = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = whole(queries)
    parts, found = max(1, -(-asked.count() // block)), []
    for i in range(parts):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i).toArrow().combine_chunks()  # a block at a time
        ids = table["vec_id"].to_numpy()
        matrix = _unit(_rows(table["embedding"].combine_chunks())) if len(ids) else np.zeros((0, 1))
        if len(ids):
            found.append(whole(vectors).mapInArrow(_scan(context.broadcast((ids, matrix)), k, least), "query_id long, vec_id long, similarity double"))
    if not found:
        return whole(vectors).limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    return best(reduce(DataFrame.union, found), "query_id", "similarity", "vec_id", k)


# texts ----------------------------------------------------------------------------------------------------------


def _terms_of(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of the ``terms`` in arrays of words."""
    number = pc.index_in(column.flatten(), value_set=terms)
    doc = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    hit = number.is_valid().to_numpy(zero_copy_only=False)
    pair, tf = np.unique(doc[hit] * len(terms) + number.drop_null().to_numpy(), return_counts=True)
    return pair // len(terms), pair % len(terms), tf


def _frequencies(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms.value)
        uses, docs, length = np.zeros(len(values), dtype=np.int64), 0, 0
        for batch in batches:
            column = batch.column("w")
            uses += np.bincount(_terms_of(column, values)[1], minlength=len(values))
            docs, length = docs + len(column), length + len(column.flatten())
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(values)), -1, -2]), pa.array([*uses.tolist(), docs, length])], names=["term", "n"])

    return run


def _bm25(shared, rows: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of the queries, a column for each of so many rows; -inf where a row has no term of the query."""
    _, idf, ids, begin, users, mean = shared
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    n = begin[term + 1] - begin[term]
    query = users[np.arange(n.sum()) + np.repeat(begin[term] - (np.cumsum(n) - n), n)]
    cell = query * rows + np.repeat(row, n)
    total = np.bincount(cell, weights=np.repeat(weight, n), minlength=len(ids) * rows)
    met = np.zeros(total.size, dtype=bool)
    met[cell] = True
    return np.where(met, total, -np.inf).reshape(len(ids), rows)


def _score(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _, ids, *_ = shared.value
        values, found = pa.array(terms), Best(len(ids), k)
        for batch in batches:
            column, own = batch.column("w"), batch.column("doc_id").to_numpy()
            doc, term, tf = _terms_of(column, values)
            found.offer(0, np.round(_bm25(shared.value, len(own), doc, term, tf, column.value_lengths().to_numpy()[doc]), 6), own)
        yield found.rows(ids, ["query_id", "doc_id", "score"])

    return run


def _users(column: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct terms of queries' words, and for each where its users begin in a list of the queries' places."""
    encoded = column.flatten().dictionary_encode()
    terms, use = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    order = np.argsort(use, kind="stable")
    users = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())[order]
    return terms, np.searchsorted(use[order], np.arange(len(terms) + 1)), users


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, block: int = TILE) -> DataFrame:
    """Rows 260 and 265: ``query_id, doc_id, score, rank``: the k best documents of each query that share a term with it.

    idf = ln((N - n + 0.5) / (n + 0.5) + 1), k1 1.5, b 0.75; a query's term counts once; scores are rounded to six digits, ties go to the
    smaller doc_id.  Texts are read twice for ``block`` queries, for the terms' counts and for the scores; documents aren't shuffled.
    Rows without doc_id or query_id take no part; null texts are empty.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    tokens = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    asked = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(words(F.col("text"))).alias("w"))
    parts, found = max(1, -(-asked.count() // block)), []
    for i in range(parts):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow().combine_chunks()  # a block at a time
        ids = table["query_id"].to_numpy()
        column = table["w"].combine_chunks() if len(ids) else pa.array([], type=pa.list_(pa.string()))
        terms, begin, users = _users(column)
        if not terms:
            continue
        counts = tokens.select("w").mapInArrow(_frequencies(context.broadcast(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
        uses = np.array([n.get(t, 0) for t in range(len(terms))])
        idf = np.log((n.get(-1, 0) - uses + 0.5) / (uses + 0.5) + 1)
        shared = context.broadcast((terms, idf, ids, begin, users, n.get(-2, 0) / max(1, n.get(-1, 0))))
        found.append(tokens.mapInArrow(_score(shared, k), "query_id long, doc_id long, score double"))
    if not found:
        return tokens.limit(0).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return best(reduce(DataFrame.union, found), "query_id", "score", "doc_id", k)


# both ------------------------------------------------------------------------------------------------------------


def _term_counts(terms):
    """A row for each document: its words' number, null for a null text, and how often it has which of the ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms.value, pa.string())
        for batch in batches:
            column = batch.column("w")
            doc, term, tf = _terms_of(column, values)
            at = pa.array(np.searchsorted(doc, np.arange(len(column) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.value_lengths(), *lists], names=["doc_id", "size", "terms", "tf"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term, frequency and size of the texts of ids."""
    size, terms, tf = column.flatten().flatten()
    n = terms.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    return np.repeat(row, n), terms.flatten().to_numpy(), tf.flatten().to_numpy(), np.repeat(size.fill_null(0).to_numpy(), n)


def _uses(width: int):
    """Texts that have each of so many terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(width, dtype=np.int64)
        for batch in batches:
            uses += np.bincount(_flat(batch.column("texts"))[1], minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(uses)], names=["term", "n"])

    return run


def _kept(df: DataFrame) -> DataFrame:
    """A scan of the table as written once to the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tokenloom-hybrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_id(counts: DataFrame) -> DataFrame:
    """``doc_id, texts``: a row for each id; equally long texts of one id are one, and their terms are summed before they meet."""
    texts = F.array(F.struct("size", "terms", "tf")).alias("texts")
    repeated = counts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    if repeated.isEmpty():
        return counts.select("doc_id", texts)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    terms = counts.join(repeated, same, "left_semi").select("doc_id", "size", F.explode(F.arrays_zip("terms", "tf")).alias("t"))
    sums = terms.groupBy("doc_id", "size", F.col("t.terms").alias("term")).agg(F.sum("t.tf").cast("int").alias("tf"))
    merged = sums.groupBy("doc_id", "size").agg(F.collect_list(F.struct("term", "tf")).alias("t")).select("doc_id", F.struct("size", F.col("t.term").alias("terms"), F.col("t.tf").alias("tf")).alias("text"))
    return _kept(counts.join(repeated, same, "left_anti").select("doc_id", texts).union(merged.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))))


def _highest(shared):
    """The highest score of each query, by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full(len(shared.value[2]), -np.inf)
        for batch in batches:
            if len(batch):
                top = np.maximum(top, _bm25(shared.value, len(batch), *_flat(batch.column("texts"))).max(axis=1))
        at = np.flatnonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top[at])], names=["at", "top"])

    return run


def _layers(ids: np.ndarray, table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of queries and a vector of each; a query with several vectors is in several layers."""
    if not len(table):
        return []
    unit, order = _unit(_rows(table["embedding"].combine_chunks())), np.argsort(ids, kind="stable")
    place = order[np.searchsorted(ids[order], table["vec_id"].to_numpy())]
    by = np.argsort(place, kind="stable")
    nth = np.empty(len(by), dtype=np.int64)
    nth[by] = np.arange(len(by)) - np.searchsorted(place[by], place[by])
    return [(place[nth == i], unit[nth == i]) for i in range(nth.max() + 1)]


def _both(shared, asked, k: int, least: float, vector_weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, _, ids, *_), (top, layers) = shared.value, asked.value
        found = Best(len(ids), k)
        for batch in batches:
            own = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            score = _bm25(shared.value, len(own), *_flat(batch.column("texts")))
            alone = np.isfinite(score)  # pairs of a text without a vector
            text = (1 - vector_weight) * np.where(alone, score / top[:, None], 0.0)
            vectors = batch.column("vectors")
            row = np.repeat(np.arange(len(own)), vectors.value_lengths().fill_null(0).to_numpy())
            if len(row):
                unit = _unit(_rows(vectors.flatten())).T
                for place, matrix in layers:
                    v = np.round(matrix @ unit, DIGITS)
                    near = (v >= least) & (ids[place, None] != own[row])
                    every = np.full((len(ids), len(row)), -np.inf)
                    every[place] = np.where(near, np.round(vector_weight * v + text[place][:, row], 6), -np.inf)
                    found.offer(0, every, own[row])
                    at, column = np.nonzero(near)
                    alone[place[at], row[column]] = False
            found.offer(0, np.where(alone, np.round(text, 6), -np.inf), own)
        yield found.rows(ids, ["query_id", "doc_id", "score"])

    return run


def hybrid_best(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, vector_weight: float = 0.7, block: int = TILE) -> DataFrame:
    """Row 82: ``query_id, doc_id, score, rank``: the k best of all documents and vectors by weighted similarity and BM25 score.

    ``docs(doc_id, text)``, ``vectors(vec_id, embedding)`` and ``queries(query_id, text)``, whose vectors are those of their ids.  Similarities from
    ``least`` on to other ids count, texts are scaled by the best of the whole table, what a side lacks counts 0; scores are rounded to six digits, ties go to the smaller id.
    Nothing is cut before the sides meet.  Texts are read once for ``block`` queries and kept as counts of their terms; these and the vectors are shuffled by id.
    Rows of one id are one document, those without id too; vectors and queries without id take no part; a vector of zeros has similarity 0;
    null texts count as documents but not for their mean length.
    """
    spark = docs.sparkSession
    ship(spark)
    context = spark.sparkContext
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), words(F.col("text"))).alias("w"))
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(words(F.col("text"))).alias("w"))
    asked = asked.groupBy("query_id").agg(F.flatten(F.collect_list("w")).alias("w"))
    of_id = whole.groupBy("vec_id").agg(F.collect_list("embedding").alias("vectors"))
    parts, found = max(1, -(-asked.count() // block)), []
    for i in range(parts):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        table = part.toArrow().combine_chunks()  # a block at a time
        if not len(table):
            continue
        ids = table["query_id"].to_numpy()
        terms, begin, users = _users(table["w"].combine_chunks())
        counts = tokens.mapInArrow(_term_counts(context.broadcast(terms)), "doc_id long, size int, terms array<int>, tf array<int>")
        counts = _kept(counts)
        rows, known, length = counts.agg(F.count("*"), F.count("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
        texts = _by_id(counts)
        sums = texts.select("texts").mapInArrow(_uses(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        uses = np.zeros(len(terms), dtype=np.int64)
        uses[sums["term"].to_numpy()] = sums["n"].to_numpy()
        idf = np.log((rows - uses + 0.5) / (uses + 0.5) + 1)
        shared = context.broadcast((terms, idf, ids, begin, users, length / max(1, known)))
        highest = texts.select("texts").mapInArrow(_highest(shared), "at long, top double").groupBy("at").agg(F.max("top").alias("top")).toArrow()
        top = np.ones(len(ids))
        top[highest["at"].to_numpy()] = highest["top"].to_numpy()
        own = whole.join(part.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").toArrow()
        both = texts.join(of_id, F.col("doc_id") == F.col("vec_id"), "full_outer").select(F.coalesce("doc_id", "vec_id").alias("doc_id"), "texts", "vectors")
        scored = _both(shared, context.broadcast((top, _layers(ids, own))), k, least, vector_weight)
        found.append(both.mapInArrow(scored, "query_id long, doc_id long, score double"))
    if not found:
        return tokens.limit(0).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return best(reduce(DataFrame.union, found), "query_id", "score", "doc_id", k).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


# approximate search ---------------------------------------------------------------------------------------------


def _planes(dimensions: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(_SEED)).standard_normal((dimensions, tables * SIGNS))


def _signatures(tables: int, probes: int):
    """A row for each vector: in each table its signs as a number, and those with one of its ``probes`` least sure signs turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            unit = _unit(_rows(batch.column("embedding")))
            if planes is None:
                planes = _planes(unit.shape[1], tables)
            margin = (unit @ planes).reshape(len(unit), tables, SIGNS)
            bit = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
            own = ((margin > 0) * bit).sum(axis=2)
            flat = pa.array(own.ravel())
            # margins only matter among the leading signs, which a bucket is told by
            bits = pa.array(np.abs(margin).astype(np.float32).ravel()) if probes else None
            at = np.arange(0, len(unit) * tables + 1, tables, dtype=np.int32)
            columns = [batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(at), flat)]
            if probes:
                columns.append(pa.ListArray.from_arrays(pa.array(at * SIGNS), bits))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "signs", *(["margins"] if probes else [])])

    return run


def _probed(tables: int, probes: int, lengths: list[int]):
    """The buckets that a query looks into: for each table and length its own and those with one of the least sure leading signs turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            own = batch.column("signs").flatten().to_numpy().reshape(n, tables)
            margin = batch.column("margins").flatten().to_numpy().reshape(n, tables, SIGNS)
            ids, t = np.repeat(batch.column("vec_id").to_numpy(), tables), np.tile(np.arange(tables), n)
            out: list[tuple[np.ndarray, ...]] = []
            for length in lengths:
                base = (own >> (SIGNS - length)).ravel()
                least = np.argsort(margin[:, :, :length].reshape(n * tables, length), axis=1)[:, :probes]
                keys = [base, *(base ^ (np.int64(1) << (length - 1 - least[:, p])) for p in range(least.shape[1]))]
                out += [(ids, t, np.full(len(ids), length), key) for key in keys]
            query, table, size, key = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(table.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key)], names=["query_id", "t", "length", "key"])

    return run


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_unit(_rows(batch.column(c))) for c in ("q", "embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.round((a * b).sum(axis=1), DIGITS))], names=["query_id", "vec_id", "similarity"])


def nearly_nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, tables: int = TABLES, probes: int = 3, crowd: int = CROWD) -> DataFrame:
    """Row 188: as ``nearest``, among the vectors that share a bucket with the query or a bucket beside its own.

    A pair of angle a agrees in a sign with probability 1 - a / pi, so close neighbours are rarely missed and far ones often; ``tables``,
    ``probes`` and ``crowd`` buy recall with comparisons.  Buckets have no cap: one that no further sign splits is compared whole.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # equal vectors are one class of the least id; the query itself may be that, so a class gives k + 1 of its members
    class_ = F.struct(F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(31), "embedding").alias("g"))
    named = whole.withColumn("c", class_)
    heads = named.groupBy("c").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"))
    classes = whole.join(heads.select(F.col("head").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    n = max(1, heads.count())
    first = min(SIGNS - STEP, max(1, int(np.ceil(np.log2(max(2, 2 * n / crowd))))))
    lengths = list(range(first, SIGNS + 1, STEP))
    signed = classes.mapInArrow(_signatures(tables, 0), "vec_id long, signs array<long>").select("vec_id", F.posexplode("signs").alias("t", "signs"))
    at = lambda length: F.shiftright("signs", SIGNS - length)
    # a bucket is the shortest beginning of the signs that few share, or all signs
    counts = signed.groupBy("t", "signs").agg(F.count("*").alias("n"))
    sizes = counts
    for length in lengths:
        sizes = sizes.withColumn(f"n{length}", F.sum("n").over(Window.partitionBy("t", at(length))))
    pick = reduce(lambda rest, length: F.when(F.col(f"n{length}") <= crowd, length).otherwise(rest), reversed(lengths[:-1]), F.lit(lengths[-1]))
    buckets = signed.join(sizes.select("t", "signs", pick.alias("length")), ["t", "signs"]).select("vec_id", "t", "length", F.expr(f"shiftright(signs, {SIGNS} - length)").alias("key"))
    signs, probed = _signatures(tables, probes), _probed(tables, probes, lengths)
    looks = asked.mapInArrow(lambda batches: probed(signs(batches)), "query_id long, t int, length int, key long")
    pairs = looks.join(buckets, ["t", "length", "key"]).select("query_id", "vec_id").distinct()
    met = pairs.join(classes, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").select("query_id", "vec_id", "q", "embedding")
    scored = met.mapInArrow(_similarities, "query_id long, vec_id long, similarity double").where(F.col("similarity") >= least)
    top = best(scored, "query_id", "similarity", "vec_id", k + 1).drop("rank")
    # copies of what was found; those of a class stand in order, and k + 1 of them are enough
    wanted = top.select(F.col("vec_id").alias("head")).distinct().join(heads.where("copies > 1"), "head")
    copies = named.join(wanted.select("c", "head"), "c").where("vec_id != head").select("head", "vec_id")
    few = copies.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (("head", "salt"), ("head",)):  # a class may hold a third of all vectors
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k)
    few = few.select("head", "vec_id")
    more = top.withColumnRenamed("vec_id", "head").join(few, "head").select("query_id", "vec_id", "similarity")
    return best(top.union(more).where("query_id != vec_id"), "query_id", "similarity", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``recall``: the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


def cached(requests: DataFrame, entries: DataFrame, least: float = 0.95, search=nearest) -> DataFrame:
    """Row 358: ``vec_id, entry, similarity`` of every request: the first entry of its hash, else the most similar one from ``least`` on, else null.

    ``requests(vec_id, hash, embedding)`` and ``entries`` alike; an entry never answers the request of its own id.  Similarity is null for a hash's hit.
    """
    first = entries.where("hash IS NOT NULL").groupBy("hash").agg(F.min("vec_id").alias("entry"))
    # the least entry of a hash but for the request's own
    ranked = entries.where("hash IS NOT NULL").join(first.select("hash", F.col("entry").alias("least_id")), "hash").where("vec_id != least_id").groupBy("hash").agg(F.min("vec_id").alias("second"))
    both = first.join(ranked, "hash", "left")
    met = requests.join(both, "hash", "left").withColumn("entry", F.when(F.col("entry") == F.col("vec_id"), F.col("second")).otherwise(F.col("entry")))
    hits = met.where("entry IS NOT NULL").select("vec_id", "entry", F.lit(None).cast("double").alias("similarity"))
    rest = requests.join(hits.select("vec_id"), "vec_id", "left_anti")
    near = search(entries, rest, 1, least).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("entry"), "similarity")
    return hits.unionByName(rest.select("vec_id").join(near, "vec_id", "left"))
