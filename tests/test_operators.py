"""Operators on small inputs with nulls, ties and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import numbers, text
from tokenloom.operators import arrays, lines, memory, metrics, neighbours, ranking, sequences


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_token_estimate(spark):
    r = one(spark, a=text.token_estimate(F.lit("abcdef")), b=text.token_estimate(F.lit("")), c=text.token_estimate(F.lit(None).cast("string")), d=text.token_estimate(F.lit("漢字かな")), e=text.token_estimate(F.lit("x")))
    assert (r.a, r.b, r.c, r.d, r.e) == (2, 0, 0, 4, 1)


def test_text_rewrites(spark):
    r = one(spark, a=text.strip_ansi(F.lit("\x1b[31mred\x1b[0m")), b=text.redact(F.lit("api_key=abc password: x")), c=text.log_shape(F.lit("took 12 ms in /var/log/x: fine")), d=text.anonymise_query(F.lit("user:bob plain")))
    assert r.a == "red" and "abc" not in r.b and r.c == "took <n> ms in <path>" and r.d == "user:* plain"


def test_numbers(spark):
    r = one(spark, a=numbers.percent(F.lit(1), F.lit(0)), b=numbers.input_bucket(F.lit(2000)), c=numbers.cached_prefix(F.lit(1300)), d=numbers.hamming(F.lit(5), F.lit(6)), e=numbers.holdout_arm(F.lit("k"), 0.0), f=numbers.recency(F.lit(2.0), F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.0, "s", 1280, 2, "treatment", 2.0)


def test_runs_fold_and_unfold(spark):
    raw = "a\n" * 3 + "long line of text\n" * 4 + "b"
    folded = lines.collapse_runs(lines.exploded(spark.createDataFrame([(1, raw)], "k long, t string"), "k", "t"), "k").first()["text"]
    assert folded == "a\na\na\nlong line of text …x4\nb"
    assert one(spark, a=lines.expand_runs(F.lit(folded))).a == raw


def test_content_types(spark):
    texts = ['[{"a": 1}]', "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@", "<!doctype html><html><head>", "a.py:1:x\nb.py:2:y", "2024-01-01 ERROR x\n2024-01-01 INFO y", "a,b,c\n1,2,3\n4,5,6", "plain words", "", None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(lines.content_type(F.col("x")).alias("t")).collect()]
    assert got[:7] == ["json", "diff", "html", "search", "log", "tabular", "text"] and got[7] == "text"


def test_empty_tables(spark):
    requests = spark.createDataFrame([], "id long, ts timestamp, instance long, model string, mode string, before long, after long")
    assert metrics.summary(requests).first()["total_requests"] == 0
    assert metrics.ledger(requests).count() in (0, 1)
    assert sequences.loops(spark.createDataFrame([], "session long, signature string, is_error boolean, bytes long"), 2).count() == 0
    assert neighbours.bm25_best(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "query_id long, text string"), 3).count() == 0


def test_ties_keep_the_first(spark):
    rows = spark.createDataFrame([(1, i, 5.0) for i in range(6)], "k long, i long, s double")
    assert [r.i for r in sequences.first_last_best(rows, "k", "i", "s", 3).orderBy("i").collect()] == [0, 1, 5]
    assert [r.vec_id for r in neighbours.best(spark.createDataFrame([(1, 9, 1.0), (1, 3, 1.0)], "q long, vec_id long, s double"), "q", "s", "vec_id", 1).collect()] == [3]


def test_dedup_tells_null_from_absent_text(spark):
    items = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, None)], "k long, i long, v string")
    assert [r.i for r in arrays.deduplicated(items, "k", "i", arrays.item_hash(F.col("v"))).orderBy("i").collect()] == [1, 2]


def test_history_and_hops(spark):
    versions = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id long, supersedes long")
    assert [r.version for r in memory.history(versions, spark.createDataFrame([(3,)], "id long")).orderBy("step").collect()] == [3, 2, 1]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    assert {(r.id, r.hops) for r in memory.k_hop(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_markers(spark):
    import datetime

    store = spark.createDataFrame([("h1", "x", datetime.datetime(2024, 1, 1), 60), ("h2", "y", datetime.datetime(2023, 1, 1), 60)], "hash string, content string, created_at timestamp, ttl long")
    got = memory.resolve(spark.createDataFrame([(1, "h1"), (1, "h2"), (2, "h3")], "doc_id long, hash string"), store, F.to_timestamp(F.lit("2024-01-01 00:00:30")))
    assert {(r.hash, r.status) for r in got.collect()} == {("h1", "found"), ("h2", "expired"), ("h3", "missing")}


def test_statistics_and_snapshot(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), ("c", None), (None, 3.0)], "k string, v double")
    got = {r.k: r for r in sequences.statistics(v, "k", "v").collect()}
    assert (got["a"].mean, got["a"].variance, got["a"].median, got["a"].p25, got["a"].p75) == (1.5, 0.5, 1.5, 1.25, 1.75)
    assert (got["b"].mean, got["b"].variance, got["b"].deviation) == (4.0, None, None)
    assert (got["c"].mean, got["c"].median) == (None, None) and got[None].median == 3.0
    assert not sequences.statistics(v.limit(0), "k", "v").count()
    r = spark.createDataFrame([("x", 10, 4), ("x", 10, 6), ("y", 0, 0), (None, 8, 2)], "m string, before long, after long")
    assert [tuple(x) for x in metrics.savings_snapshot(r, "m").collect()] == [("x", 10, 10, 50.0), (None, 6, 2, 75.0), ("y", 0, 0, 0.0)]
    assert not metrics.savings_snapshot(r.limit(0), "m").count()
