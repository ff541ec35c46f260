"""Crushed JSON against plain Python."""

from __future__ import annotations

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom.functions.text import has_error_word
from tokenloom.operators import nested as N

WORDS = ["ok", "fine words here", "an ERROR came", "x" * 90, "ok", "plain", "Failed to run", "done", "é漢"]


def edges(k):
    front = min(max(1, round(k * 0.3)), k)
    return front, min(max(1, round(k * 0.15)), k - front)


def far(xs):
    sd = statistics.stdev(xs) if len(xs) > 1 else 0
    m = sum(xs) / len(xs)
    return [sd > 0 and abs(x - m) > 2 * sd for x in xs]


def plain_strings(values, k, failing):
    n = len(values)
    if n <= 8:
        return list(range(n))
    front, back = edges(k)
    odd = far([len(v) for v in values])
    fails = [failing[v] for v in values]
    keep = {i for i in range(n) if fails[i] or odd[i] or i < front or i >= n - back}
    seen, cap, budget = {values[i] for i in keep}, k + sum(fails) + sum(odd), max(0, k - len(keep))
    if budget:
        for i in range(0, n, max(1, (n - 1) // (budget + 1))):
            if len(keep) >= cap:
                break
            if i not in keep and values[i] not in seen:
                keep.add(i)
                seen.add(values[i])
    return sorted(keep)


def plain_keys(entries, k, failing, least_tokens):
    n = len(entries)
    tokens = [len(j.encode()) // 4 + len(name.encode()) // 4 + 2 for name, j in entries]
    if n <= 8 or sum(tokens) < least_tokens or n <= k:
        return list(range(n))
    front, back = edges(k)
    fails = [failing[j] for _, j in entries]
    keep = {i for i in range(n) if fails[i] or tokens[i] <= 12 or i < front or i >= n - back}
    left = k - len(keep)
    if left > 0:
        for i in range(0, n, max(1, (n - 1) // (left + 1))):
            if len(keep) >= k + sum(fails):
                break
            keep.add(i)
    return sorted(keep)


def dumps(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(v[k])}" for k in sorted(v, key=lambda x: x.encode())) + "}"
    return "[" + ",".join(map(dumps, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)


def plain_items(items, k, failing):
    if len(items) <= 8:
        return list(range(len(items)))
    kind = lambda v: "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "number" if isinstance(v, int | float) and not isinstance(v, bool) else "other"
    groups, keep = {}, set()
    for i, v in enumerate(items):
        groups.setdefault(kind(v), []).append(i)
    for g, at in groups.items():
        if len(at) < 5 or g == "other":
            keep |= set(at)
        elif g == "number":
            front, back = edges(k)
            odd = far([float(items[i]) for i in at])
            keep |= {i for p, i in enumerate(at) if p < front or p >= len(at) - back or odd[p]}
        else:
            texts = [items[i] if g == "string" else dumps(items[i]) for i in at]
            same = {texts[p] for p in plain_strings(texts, k, failing)}
            keep |= {i for p, i in enumerate(at) if texts[p] in same}
    return sorted(keep)


def plain_crush(v, k, failing, least_tokens):
    if isinstance(v, dict):
        names = sorted(v, key=lambda x: x.encode())
        keep = plain_keys([(n, dumps(v[n])) for n in names], k, failing, least_tokens)
        return {names[i]: plain_crush(v[names[i]], k, failing, least_tokens) for i in keep}
    if isinstance(v, list):
        if len(v) >= 5 and not all(x is None or isinstance(x, bool | list) for x in v):
            keep = plain_items(v, k, failing)
            lost = [dumps(x) for i, x in enumerate(v) if i not in keep and isinstance(x, dict)]
            mark = [{"_ccr_dropped": f"<<ccr:{hashlib.sha256(chr(10).join(lost).encode()).hexdigest()[:12]} {len(lost)}_rows_offloaded>>"}] if lost else []
            return [v[i] for i in keep] + mark
        return [plain_crush(x, k, failing, least_tokens) for x in v]
    return v


def failing_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").select("t", has_error_word(F.col("t")).alias("f")).collect()
    return {r.t: r.f for r in rows}


def strings(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS[:2] + WORDS[4:6] + [f"line {rng.randrange(20)}"] * 5 + (WORDS if rng.random() < 0.3 else [])) for _ in range(n)]


def texts_in(v):
    if isinstance(v, dict):
        yield from (dumps(x) for x in v.values())
        for x in v.values():
            yield from texts_in(x)
    if isinstance(v, list):
        for x in v:
            yield x if isinstance(x, str) else dumps(x)
            yield from texts_in(x)


@pytest.mark.parametrize("k", [1, 6, 15])
def test_strings(spark, k):
    arrays = [strings(s, n) for s, n in enumerate([0, 1, 8, 9, 12, 30, 60, 200])] + [["same"] * 40]
    df = spark.createDataFrame([(a, i * 2, v, "x", 0) for a, own in enumerate(arrays) for i, v in enumerate(own)], "key long, i long, value string, _p string, n int").select("key", "i", "value").repartition(3)
    failing = failing_of(spark, [v for own in arrays for v in own])
    got = {}
    for r in N.kept_strings(df, k).collect():
        got.setdefault(r.key, []).append(r.i // 2)
    assert {a: sorted(x) for a, x in got.items()} == {a: plain_strings(own, k, failing) for a, own in enumerate(arrays) if own}


def test_keys(spark):
    objects = [[(f"k{i:03}", json.dumps("v" * (i * 7 % 60) + (" error" if i % 11 == 3 else ""))) for i in range(n)] for n in (1, 8, 9, 30, 120)]
    df = spark.createDataFrame([(o, i, *e) for o, own in enumerate(objects) for i, e in enumerate(own)], "key long, i long, name string, json string").repartition(3)
    failing = failing_of(spark, [j for own in objects for _, j in own])
    for k, least in ((5, 200), (15, 10), (40, 10)):
        got = {}
        for r in N.kept_keys(df, k, least).collect():
            got.setdefault(r.key, []).append(r.i)
        assert {o: sorted(x) for o, x in got.items()} == {o: plain_keys(own, k, failing, least) for o, own in enumerate(objects)}


def test_ties_at_two_deviations(spark):
    """Whole numbers at just two deviations aren't far, in any order of rows."""
    bases = [[5] * 12 + [6, 6, 6, 4, 4], [5] * 12 + [6, 6, 4, 4, 4], [6, 5, 8, 8, 5, 6, 6, 6, 6, 5, 5, 6, 6], [5] * 7 + [4, 6], [0, 0, 0, 0, 10**7, 0], [3] * 9, [1, 2], [7]]
    arrays = [own[k:] + own[:k] for own in bases for k in range(len(own))]

    def exactly(xs):
        n, s, q = len(xs), sum(xs), sum(x * x for x in xs)
        return [(n * x - s) ** 2 * (n - 1) > 4 * n * (n * q - s * s) for x in xs]

    df = spark.createDataFrame([(a, i, float(x)) for a, own in enumerate(arrays) for i, x in enumerate(own)], "key long, i long, x double")
    for scale in (1.0, 1e250, 1e-3):
        got = {(r.key, r.i): r.f for r in df.select("key", "i", N._far(F.col("x") * scale, Window.partitionBy("key")).alias("f")).collect()}
        if scale == 1:
            assert got == {(a, i): f for a, own in enumerate(arrays) for i, f in enumerate(exactly(own))}
        assert len(got) == sum(map(len, arrays))


def documents():
    rng = random.Random(9)
    row = lambda i: {"id": i, "msg": rng.choice(WORDS), "at": {"x": i % 3}}
    mixed = [rng.choice([i, f"s{i % 7}", row(i), None, True, [i], i * 1.5]) for i in range(60)]
    wide = {f"field{i:02}": "value " * (i % 9) + ("error" if i == 17 else "") for i in range(40)}
    return [
        {"rows": [row(i) for i in range(40)], "words": strings(3, 50), "numbers": [*range(30), 10_000], "deep": {"a": {"b": [mixed, [1, 2]]}}},
        mixed, wide, {"w": wide, "l": [[], {}, [[1] * 12]], "e": []}, [], {}, 5, "text", [True] * 20, [1, 2, 3, 4], [[strings(1, 20)]], None,
    ]


def test_documents(spark):
    docs = documents()
    df = spark.createDataFrame([(i, None if d is None else dumps(d)) for i, d in enumerate(docs)], "id long, j string").select("id", F.parse_json("j").alias("value"))
    failing = failing_of(spark, [t for d in docs for t in texts_in(d)])
    reduced, taken = N.crushed(df, 8)
    got = {r.id: r.json for r in reduced.collect()}
    assert {i: None if x is None else json.loads(x) for i, x in got.items()} == {i: None if d is None else plain_crush(d, 8, failing, 200) for i, d in enumerate(docs)}
    lost = [(r.id, r.json) for r in taken.collect()]
    assert lost and not any(failing.get(json.loads(j) if j.startswith('"') else j) for _, j in lost)
    assert N.crushed(df.limit(0), 8)[0].count() == 0
