"""Exact and approximate neighbours, best texts and the semantic cache against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, similarity double, rank int"


def clustered(n, seed=3, dim=32):
    """Families of edited vectors, copies among them."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12 + 1, dim))
    return [[float(x) for x in np.float32(centres[i // 12] + 0.25 * rng.standard_normal(dim))] for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    own = clustered(600)
    for k in range(590, 600):
        own[k] = own[580]  # copies
    own[7] = [0.0] * 32
    return [(i, v, 0.5, 1) for i, v in enumerate(own)] + [(None, own[3], 0.5, 1), (700, None, 0.5, 1)]


def plain_nearest(rows, ids, k, least):
    whole = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows if i is not None and v is not None}
    unit = {i: v / n if (n := np.sqrt((v * v).sum())) else v for i, v in whole.items()}
    out = {}
    for q in ids:
        scored = sorted((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q)
        out[q] = [i for s, i in scored if -s >= least][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("block", [N.QUERY_BLOCK, 20])
def test_nearest(spark, rows, block):
    v = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ids = list(range(0, 600, 10))
    got = found(N.nearest(v, v.where("vec_id % 10 = 0"), 5, 0.2, block))
    assert got == {q: x for q, x in plain_nearest(rows, ids, 5, 0.2).items() if x}
    assert N.nearest(v, v.where("vec_id < 0"), 5).count() == 0 and N.nearest(v.limit(0), v.where("vec_id = 10"), 5).count() == 0


@pytest.mark.parametrize("crowd", [40, 1024])
def test_nearly_nearest(spark, rows, crowd):
    v = spark.createDataFrame(rows, SCHEMA).repartition(4)
    q = v.where("vec_id % 10 = 0 AND vec_id != 700")
    near, exact = N.nearly_nearest(v, q, 5, 0.2, crowd=crowd).cache(), N.nearest(v, q, 5, 0.2)
    assert N.recall(near, exact).first().recall >= 0.95
    assert found(near)[590] == [580, 591, 592, 593, 594]  # copies by id
    assert N.nearly_nearest(v.limit(0), q.limit(0), 5).count() == 0


def test_recall_on_the_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    assert N.recall(N.nearly_nearest(e, q, 10, 0.1), N.nearest(e, q, 10, 0.1)).first().recall >= 0.9


def plain_bm25(docs, queries, k):
    import re

    words = lambda t: re.findall(r"[a-z0-9_]+", (t or "").lower())
    own = {d: words(t) for d, t in docs if d is not None}
    mean = sum(map(len, own.values())) / len(own)
    out = {}
    for q, t in queries:
        scores = {}
        for term in set(words(t)):
            df = sum(term in w for w in own.values())
            for d, w in own.items():
                if tf := w.count(term):
                    scores[d] = scores.get(d, 0) + math.log((len(own) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if scores:
            out[q] = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
    return out


def test_bm25(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("aa bb cc dd, ee ff Gg h_1".split(), k=rng.randrange(12)))) for i in range(80)] + [(90, None), (91, "é"), (None, "aa aa")]
    queries = [(i, " ".join(rng.choices("aa bb zz gg ee".split(), k=3))) for i in range(9)] + [(20, ""), (21, None), (22, "nowhere"), (None, "aa")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    for block in (N.TILE, 4):
        got = {}
        for r in N.bm25_best(d, q, 4, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
        assert got == plain_bm25(docs, [x for x in queries if x[0] is not None], 4)
    assert N.bm25_best(d.limit(0), q, 3).count() == 0 and N.bm25_best(d, q.limit(0), 3).count() == 0


def test_cache(spark, rows):
    v = spark.createDataFrame(rows, SCHEMA).where("vec_id IS NOT NULL").withColumn("hash", F.when(F.col("vec_id") % 100 < 40, F.concat(F.lit("h"), (F.col("vec_id") % 20).cast("string"))))
    got = {r.vec_id: r for r in N.cached(v.where("vec_id % 5 = 0"), v, 0.8).collect()}
    assert len(got) == 121 and got[0].entry == 20 and got[20].entry == 0 and got[0].similarity is None and got[700].entry == 0
    near = plain_nearest(rows, [i for i in range(0, 600, 5) if i % 100 >= 40], 1, 0.8)
    assert {q: [got[q].entry] if got[q].entry is not None else [] for q in near} == near


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    """Tables whose best sums are below the hundred best of either side, with odd ids: (folder, rows by the query's SQL)."""
    import duckdb

    from tokenloom.plans.catalogue import SQL

    rng = random.Random(5)
    at = lambda cos: [cos, math.sqrt(1 - cos * cos)] + [0.0] * 8
    docs = [(i, "xx yy zz") for i in range(1000, 1150)] + [(5000, "xx yy zz dd ee ff gg hh")]
    docs += [(i, " ".join(rng.choices("aa bb cc, dd ee Ff h_1".split(), k=rng.randrange(1, 12)))) for i in range(60)]
    docs += [(3, "aa dd dd"), (3, "aa zz dd"), (4, "bb"), (None, "aa bb"), (None, "cc cc cc cc"), (9000, None), (9001, "")]
    vectors = [(0, at(1.0)), (5000, at(0.55))] + [(i, at(0.6 + (i - 2000) / 1e4)) for i in range(2000, 2150)]
    vectors += [(i, [0.0, 0.0] + [rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 80)] + [(3, at(0.3)), (4, at(0.2)), (None, at(0.9)), (9000, None)]
    items = [(0, "xx yy zz"), (1, "dd, AA dd"), (2, None), (3, "h_1 ee"), (3, "ee aa"), (4, "nowhere"), (5, ""), (7777, "ff"), (None, "aa"), (9000, "bb")]
    folder = str(tmp_path_factory.mktemp("merged"))
    c = duckdb.connect()
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, c.execute(SQL["hybrid_top"]).fetchall()


def test_hybrid(spark, merged):
    from tokenloom.plans.catalogue import QUERIES

    folder, want = merged
    plain = lambda rows: sorted((q, rank, f"{s:.6f}", str(d)) for q, d, s, rank in rows)
    got = QUERIES["hybrid_top"](spark, folder).select("query_id", "doc_id", "score", "rank").collect()
    assert (0, 1, 5000) in {(r.query_id, r.rank, r.doc_id) for r in got}  # the 151st by either side
    assert plain(got) == plain(want)


def test_hybrid_in_blocks(spark, merged):
    d, v, q = (spark.read.parquet(f"{merged[0]}/{t}.parquet") for t in ("documents", "embeddings", "benchmark"))
    q = q.withColumnRenamed("item_id", "query_id")
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(N.hybrid_best(d, v, q, 10, 0.1, block=3)) == rows(N.hybrid_best(d, v, q, 10, 0.1))
    assert N.hybrid_best(d, v, q.limit(0), 3).count() == 0 and N.hybrid_best(d.limit(0), v.limit(0), q, 3).count() == 0
    assert found(N.hybrid_best(d.limit(0), v, q.where("query_id = 1"), 5, 0.1).withColumnRenamed("doc_id", "vec_id")) == found(N.nearest(v, v.where("vec_id = 1"), 5, 0.1))
