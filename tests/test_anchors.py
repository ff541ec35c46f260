"""Anchors against a plain version."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import anchors as A


def plain_weights(pattern, query):
    front, middle, back = A.WEIGHTS.get(pattern, A.WEIGHTS["generic"])
    q = (query or "").lower()
    late, early = any(x in q for x in A.RECENT), any(x in q for x in A.EARLY)
    if late != early:
        front, back = (max(0.1, front - 0.15), min(0.8, back + 0.15)) if late else (min(0.8, front + 0.15), max(0.1, back - 0.15))
    total = front + middle + back
    return front / total, back / total


def spread(low, high, count):
    size = high - low
    if count < 1 or size < 1:
        return []
    return list(range(low, high)) if count >= size else [min(high - 1, low + int(round((i + 1) * size / (count + 1), 9))) for i in range(count)]


def plain_anchors(values, scores, most, pattern, query):
    n = len(values)
    if n <= most:
        return set(range(n))
    budget = min(n, 12, max(3, int(most * 0.25)))
    wf, wb = plain_weights(pattern, query)
    front, back = max(1, int(round(budget * wf, 9))), max(1, int(round(budget * wb, 9)))
    middle = max(0, budget - front - back)
    back = max(1, back - max(0, front + back - budget))
    seen, ends = set(), []
    for low, high, count in ((0, min(2 * front, n // 3), front), (max(n - 2 * back, 2 * n // 3), n, back)):
        for p in spread(low, high, count):
            for d in (0,) if count >= high - low else (0, 1, -1, 2, -2):
                if low <= p + d < high and values[p + d] not in seen:
                    seen.add(values[p + d])
                    ends.append(p + d)
                    break
    in_front = sum(p < min(2 * front, n // 3) for p in ends)
    low, high = in_front, n - (len(ends) - in_front)
    asked = [p for p in spread(low, high, min(3 * middle, high - low)) if values[p] not in seen]
    out = set(ends)
    for p in sorted(asked, key=lambda p: (-scores[p], p))[:middle]:
        if values[p] not in seen:
            seen.add(values[p])
            out.add(p)
    return out


@pytest.mark.parametrize("most", [4, 20, 60])
def test_anchors(spark, most):
    rng = random.Random(most)
    arrays = []
    for n in (1, 4, 5, 9, 30, 100, 400):
        for pattern in ("search_results", "logs", "time_series", None):
            pool = [f"v{k}" for k in range(rng.choice([2, 10, 1000]))] + [None]
            arrays.append((pattern, rng.choice([None, "", "the LATEST one", "first of all", "first and last"]), [rng.choice(pool) for _ in range(n)], [round(rng.random(), 2) for _ in range(n)]))
    rows = [(k, i * 3, v, s, "x") for k, a in enumerate(arrays) for i, (v, s) in enumerate(zip(a[2], a[3], strict=True))]
    items = spark.createDataFrame(rows, "key long, i long, value string, score double, p string").repartition(3)
    told = spark.createDataFrame([(k, a[0], a[1]) for k, a in enumerate(arrays) if a[0] or a[1]], "key long, pattern string, query string")
    got = {}
    for r in A.anchors(items, told, most).collect():
        got.setdefault(r.key, set()).add(r.i // 3)
    want = {k: plain_anchors(a[2], a[3], most, a[0], a[1]) for k, a in enumerate(arrays)}
    assert got == want
    assert all(len(x) <= max(12, most) for x in got.values())
    assert A.anchors(items.limit(0), told, most).count() == 0


def test_query_anchors(spark):
    q = "find 550e8400-E29B-41d4-a716-446655440000 or 12345 (not 123) at db1.Example.com, e.g. 'Two Words' \"x\" Me@Mail.org"
    df = spark.createDataFrame([(q,), ("",), (None,)], "q string").select(A.query_anchors(F.col("q")).alias("a"))
    a, b, c = (r.a for r in df.collect())
    assert {"550e8400-e29b-41d4-a716-446655440000", "12345", "db1.example.com", "two words", "me@mail.org"} <= set(a)
    assert "123" not in a and "x" not in a and "e.g" not in a and b == c == []
    items = spark.createDataFrame([(1, 0, "host DB1.example.com"), (1, 1, "nothing"), (1, 2, None), (1, 3, "id=12345"), (2, 0, "12345")], "key long, i long, value string")
    names = spark.createDataFrame([(1, a)], "key long, names array<string>")
    kept = spark.createDataFrame([(1, 1), (1, 3)], "key long, i long")
    assert {(r.key, r.i): r.forced for r in A.with_forced(kept, items, names).collect()} == {(1, 0): True, (1, 1): False, (1, 3): True}


def test_preserved(spark):
    h = hashlib.sha256(b"user").hexdigest()[:8]
    fields = spark.createDataFrame([(1, 0, "user", "Ann"), (1, 1, "user", "Bob"), (1, 2, "name", "Ann"), (1, 3, "user", None), (1, 4, "user", "is ann here too?")], "key long, i long, field string, value string")
    assert {r.i for r in A.preserved(fields, [h], F.lit("is Ann here")).collect()} == {0, 4}
    assert A.preserved(fields, [h], F.lit("")).count() == 0
