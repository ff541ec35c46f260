"""Sequential rules: small cases, and the queries that spread them against a plain loop."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import agents, greedy
from tokenloom.plans.agents import QUERIES_OF_GREEDY_RULES as RULES
from tokenloom.plans.catalogue import QUERIES
from tokenloom.plans import streams  # noqa: F401  registers its queries
from tokenloom.streaming import state


def test_first_fit_takes_later_small_ones():
    assert greedy.first_fit([5, 9, 4, 1], 10) == [True, False, True, True]


def test_unique_count():
    assert greedy.unique_count([]) == 0
    assert greedy.unique_count(["the same words here", "the same words here", "something else entirely 123"]) == 2


def test_knee():
    assert greedy.knee_of([1, 1]) is None and greedy.knee_of([2, 2, 2]) == 1
    assert greedy.knee_of([0, 8, 9, 10, 10]) == 2 and greedy.knee_of([0, 1, 2, 3]) is None


def test_keep_count_bounds():
    assert greedy.keep_count(["a"] * 8) == 8
    assert greedy.keep_count(["same line"] * 50) == 3
    assert 3 <= greedy.keep_count([f"row {i} of {i * 7}" for i in range(60)]) <= 60


def test_rouge():
    assert greedy.rouge_l("a b c d".split(), "a x c d".split()) == 0.75
    assert greedy.rouge_l([], []) == 1.0 and greedy.rouge_l(["a"], []) == 0.0


def test_merged_similar():
    assert greedy.merged_similar(["a b c", "a b c d", "x", "b c a"], 0.7) == [0, 0, 2, 0]


def test_batches():
    assert greedy.batches([1, 1, 1, 1, 9, 1], list("aaaabb"), 3, 9) == [0, 0, 0, 1, 2, 3]


def test_novel_sentences():
    assert greedy.novel_sentences(["a b c d", "a b c d", "new words in here"], [1, 1, 0.5], 100) == [0, 2]


def test_aimd():
    assert state.aimd(3, ["TOO_LITTLE"]) == 2 and state.aimd(2, ["TOO_MUCH"] * 3) == 3 and state.aimd(1, ["TOO_LITTLE"] * 3) == 1


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_frames_cut_anywhere(size):
    raw = "event: a\ndata: é漢\ndata: two\n\n: note\n\ndata: x\r\n\r\ndata: open".encode()
    rest, out = b"", []
    for i in range(0, len(raw), size):
        events, rest = state.split_frames(rest + raw[i : i + size])
        out += events
    assert out == [("a", "é漢\ntwo"), ("message", "x")] and rest == b"data: open"


def test_framed_stream(spark, tmp_path):
    text = "event: t\ndata: über\n\n" * 5 + "data: rest"
    rows = [(c, i, text.encode()[i * 4 : i * 4 + 4]) for c in (1, 2) for i in range(-(-len(text.encode()) // 4))]
    chunks = spark.createDataFrame(rows, "conn long, seq long, bytes binary")
    chunks.where("seq < 9").write.parquet(f"{tmp_path}/a/1")
    chunks.where("seq >= 9").write.parquet(f"{tmp_path}/a/2")
    from tokenloom.streaming.windows import drained

    stream = spark.readStream.schema(chunks.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/a")
    got = sorted((r.conn, r.n, r.event, r.data) for r in drained(state.framed(stream), "append").collect())
    assert got == [(c, n, "t", "über") for c in (1, 2) for n in range(5)]


def test_rate_limit_is_the_plain_loop(spark, sf):
    got = {r.id: (r.admitted, round(r.wait, 6)) for r in QUERIES["stream_rate_limit"](spark, sf).collect()}
    events = duckdb.sql(f"SELECT event_type, event_id, epoch_us(ts) / 1e8 AS secs FROM '{sf}/events.parquet' ORDER BY event_type, secs, event_id").fetchall()
    level: dict[str, tuple[float, float | None]] = {}
    want = {}
    for kind, i, at in events:
        tokens, then = level.get(kind, (1.0, None))
        tokens, admitted, wait = state.bucket_step(tokens, then, at, 1.0, 1.0)
        level[kind] = (tokens, at)
        want[i] = (admitted, round(wait, 6))
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in want.items()}
    assert 0 < sum(a for a, _ in want.values()) < len(want)


@pytest.mark.parametrize("name", RULES)
def test_groups_do_not_depend_on_partitions(spark, sf, name):
    one = QUERIES[name](spark, sf)
    again = one.repartition(3)
    key = sorted(one.columns)
    rows = lambda df: sorted(map(str, df.select(*key).collect()))
    assert rows(one) == rows(again) and one.count() > 0


def test_by_group_orders_rows(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("k"), (F.lit(100) - F.col("id")).alias("o"))
    out = greedy.by_group(df, "k", ["o"], lambda pdf: pd.DataFrame({"k": pdf["k"], "first": [pdf["o"][0]] * len(pdf)}), "k long, first long")
    assert {(r.k, r.first) for r in out.collect()} == {(0, 82), (1, 81)}


def test_first_fit_rows(spark):
    """Groups of all sizes, odd ranks and sizes against one group at a time."""
    rng, nan = random.Random(2), float("nan")
    rows = [(k, i, rng.choice([-1.5, 0.0, 2.0, nan, None, 7.0]), rng.choice([0, 1, 5, 30, 90, None])) for k in (None, 1, 2, 3) for i in range(1 if k == 3 else 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user long, id long, rank double, size long").repartition(3)
    got = {(r.user, r.id): r.kept for r in greedy.first_fit_rows(df, "user", ["rank", "id"], "size", 200).collect()}
    want = {}
    for user in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2] is None or r[2] != r[2], 0 if r[2] is None or r[2] != r[2] else r[2], r[1]))
        want |= {(user, r[1]): f for r, f in zip(own, greedy.first_fit([10**9 if r[3] is None else r[3] for r in own], 200), strict=True)}
    assert got == want
    assert greedy.first_fit_rows(df.limit(0), "user", ["rank", "id"], "size", 200).count() == 0


def test_typos_by_names(spark):
    """Rows of one name are compared as one, and stand for all their pairs."""
    rng = random.Random(3)
    rows = [(k % 90, rng.choice(["a", "b", None]), rng.choice(["red bolt", "red bolts", "blue ring", "bolt", "ring", "é漢", "", None])) for k in range(100)]
    df = spark.createDataFrame(rows, "key long, brand string, name string")
    found = agents.likely_typos(df, ["brand"], "name", "key")
    old = df.selectExpr("key AS a", "brand", "name AS n").join(df.selectExpr("key AS b", "brand", "name AS m"), "brand").where("a < b AND levenshtein(n, m) <= greatest(2, floor(greatest(length(n), length(m)) / 3))")
    assert sorted(found.collect()) == sorted(old.select("a", "b").collect()) != []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("levenshtein")[1]
