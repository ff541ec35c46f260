"""Rules on fields, requests and commands on small inputs with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import fields, greedy, policy

LONG = "key long, i long, field string, kind string, value string, number double"


def test_outliers_and_scores_of_items(spark):
    rows = [(1, i, "state", "string", "bad" if i == 7 else "ok", None) for i in range(12)] + [(1, 3, "extra", "string", None, None)] + [(2, 0, "state", "string", "odd", None)]
    values = spark.createDataFrame(rows, LONG)
    assert {(r.key, r.i) for r in fields.structural_outliers(values).collect()} == {(1, 3), (1, 7)}
    score = {(r.key, r.i): r.score for r in fields.information(values).collect()}
    assert score[(2, 0)] == 0.5 and score[(1, 7)] > score[(1, 0)] and score[(1, 3)] > score[(1, 0)] and all(0 <= s <= 1 for s in score.values())
    nothing = values.limit(0)
    assert fields.structural_outliers(nothing).count() == fields.information(nothing).count() == fields.scores(nothing).count() == fields.patterns(nothing).count() == 0


def test_patterns(spark):
    def item(key, i, **named):
        return [(key, i, f, "numeric" if isinstance(v, float) else "string", str(v), v if isinstance(v, float) else None) for f, v in named.items()]

    rows = []
    for i in range(30):
        rows += item(1, i, at=f"2024-01-{i % 28 + 1:02d}T10:00:00Z", load=float(i * i))
        rows += item(2, i, message=f"a long text without repeats {i}", level="info" if i else "error")
        rows += item(3, i, relevance=(30 - i) / 31)
        rows += item(4, i, name="x", score=float(i))
        rows += item(5, i, clock=1.7e9 + i * i)
    rows += [(6, 0, "at", "string", None, None)]
    got = {r.key: r.pattern for r in fields.patterns(spark.createDataFrame(rows, LONG)).collect()}
    assert got == {1: "time_series", 2: "logs", 3: "search_results", 4: "generic", 5: "time_series", 6: "generic"}
    sure = {(r.key, r.field): r.confidence for r in fields.scores(spark.createDataFrame(rows, LONG)).collect()}
    assert sure[(3, "relevance")] == 0.8 and sure[(4, "score")] == 0.0


def plain_kept(x, keep):
    """Row 205 in plain Python."""
    n = len(x)
    if n <= 8:
        return set(range(n))
    mean, sd = statistics.mean(x), statistics.stdev(x)
    far = {i for i, v in enumerate(x) if sd and abs(v - mean) > 2 * sd}
    turns = {i for i in range(5, n - 5) if n > 10 and sd and abs(statistics.mean(x[i : i + 5]) - statistics.mean(x[i - 5 : i])) > 2 * sd}
    kept = far | turns | set(range(max(1, round(0.3 * keep)))) | set(range(n - max(1, round(0.15 * keep)), n))
    left, i = max(0, keep - len(kept)), 0
    step = max(1, (n - 1) // (left + 1))
    while left and i < n and len(kept) < keep + len(far):
        kept.add(i)
        i += step
    return kept


def test_kept_numbers(spark):
    arrays = {1: [1.0] * 30, 2: [float(i % 7) for i in range(40)], 3: [1.0, 2.0], 4: [0.0] * 20 + [50.0] + [1.0] * 9, 5: [0.0] * 12 + [9.0] * 12, 6: [float(i) for i in range(9)]}
    rows = [(k, i, v) for k, x in arrays.items() for i, v in enumerate(x)]
    got = {}
    for r in fields.kept_numbers(spark.createDataFrame(rows, "key long, i long, number double"), 10).collect():
        got.setdefault(r.key, set()).add(r.i)
    assert got == {k: plain_kept(x, 10) for k, x in arrays.items()}
    odd = spark.createDataFrame([(1, i, None if i % 2 else float("nan")) for i in range(12)], "key long, i long, number double")
    assert {r.why for r in fields.kept_numbers(odd, 10).collect()} == {"edge", "spread"}
    assert fields.number_summary(odd).count() == fields.kept_numbers(odd.limit(0), 10).count() == 0


def test_distributions(spark):
    rows = [("a", '{"n": -1, "s": "abcdefg", "m": 1, "l": [1]}'), ("a", '{"n": 2.5, "s": "hijklmn", "m": "x", "l": null}'), ("a", "no json"), ("a", None), ("a", "[1]"), (None, '{"b": true}')]
    got = {(r.by, r.field): r for r in fields.distributions(spark.createDataFrame(rows, "by string, j string"), "by", "j").collect()}
    assert {k: r.type for k, r in got.items()} == {("a", "n"): "numeric", ("a", "s"): "string", ("a", "m"): "mixed", ("a", "l"): "mixed", (None, "b"): "boolean"}
    n, s = got[("a", "n")], got[("a", "s")]
    assert n.negative and not n.whole and n.spread == "low" and not n.outliers and s.id_like and s.mean_length == 7 and s.negative is None


def test_json_equality(spark):
    pairs = [('{"a":1,"b":[1,2]}', '{"b": [1, 2], "a": 1}', True), ("[1,2]", "[2,1]", False), ("1", '"1"', False), ("1", "true", False), ("null", "null", True), (None, "1", False), ("x", "x", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.got == r.same for r in rows.select("same", policy.same_json(F.col("a"), F.col("b")).alias("got")).collect())


def test_commands(spark):
    reads = {"cat a.py": True, "cat a > b": False, "cd /x && sudo head a": True, "sed -n 1,3p a": True, "sed s/a/b/ a": False, "tail -f go.sum": False, "": False, None: False, "catalog x": False, "/bin/cat x": True}
    rows = spark.createDataFrame([(c, r) for c, r in reads.items()], "c string, r boolean")
    assert all(x.got == x.r for x in rows.select("r", policy.reads_file(F.col("c")).alias("got")).collect())
    pairs = [("pytest tests/a.py", "pytest tests/a.py -x", True), ("grep aaaa one", "grep bbbbbbbbbbbb another/file", False), ("make build-all", "make -j4 --always build-all x y z w v u t s r q", True), ("ls", "ls", False), (None, "ls", False), ("ls a", "cat a", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, r boolean")
    assert all(x.got == x.r for x in rows.select("r", policy.retried(F.col("a"), F.col("b")).alias("got")).collect())


def test_requests(spark):
    assert [r.o for r in spark.createDataFrame([("a", " "), ("", ""), ("a", None), (None, None), ("a", "b")], "t string, r string").select(policy.never_blank(F.col("t"), F.col("r")).alias("o")).collect()] == ["a", "", "a", None, "b"]
    blocks = spark.createDataFrame([(1, 0, "user", "text", None), (2, 0, "user", "tool_result", False), (2, 0, "user", "tool_result", True), (3, 0, "user", "tool_result", None), (4, 0, "user", "text", None), (4, 1, "assistant", "text", None), (5, 0, None, None, None)], "id long, at long, role string, kind string, is_error boolean")
    assert {r.id: r.kind for r in policy.turn_kinds(blocks, "id", "at").collect()} == {1: "new_ask", 2: "error_continuation", 3: "continuation", 4: "unknown", 5: "unknown"}
    assert {r.id: r.frozen for r in policy.stable_prefix(blocks.dropDuplicates(["id", "at"]), "id", "at", F.col("role") == "user").collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    assert policy.turn_kinds(blocks.limit(0), "id", "at").count() == 0


def test_sections(spark):
    rows = spark.createDataFrame([(1, 0, 5, 900), (1, 1, 5, 900), (1, 2, 9, 300), (2, 0, 1, 5000), (3, 0, 1, 1)], "f long, at long, saved long, cost long")
    assert {(r.f, r.at) for r in policy.capped(rows, "f", "at", 1300).collect()} == {(1, 0), (1, 2), (2, 0), (3, 0)}
    heads = lambda *x: spark.createDataFrame(list(enumerate(x)), "place long, heading string")
    got = policy.merged_sections(heads("Build Steps", None), heads("build-steps", "Tests", "tests!", None), F.col("heading")).collect()
    assert sorted((r.heading or "", r.carried) for r in got) == [("", False), ("Build Steps", False), ("Tests", True)]
    with pytest.raises(ValueError):
        policy.page(rows, "cost", "f", 1)


def test_rouge_of_pairs(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], []), (None, ["a"]), (["a"], None)], "x array<string>, y array<string>")
    assert [r.s for r in rows.select(greedy.rouge_column("x", "y").alias("s")).collect()] == [0.8, 1.0, 0.0, 0.0]
