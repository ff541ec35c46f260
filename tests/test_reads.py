"""Audits of reads and their maturing against plain folds, in batch and as a stream."""

from __future__ import annotations

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import reads as R
from tokenloom.streaming import reads as S
from tokenloom.streaming.windows import drained

SCHEMA = "session string, at long, path string, kind string, low int, high int, bytes long, line int"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", "c"):
        for t in range(60):
            low = rng.randrange(20)
            rows.append((s, t * 3 + rng.randrange(2), rng.choice(["x", "y", "z", None]), rng.choice(["read", "read", "write"]), low, low + rng.randrange(12), rng.randrange(500), 1))
    return [*rows, ("d", 5, "x", "read", 0, 10, 100, 1), rows[0], ("d", 6, "x", "read", 3, 3, 0, 1)]


def plain_audit(rows):
    out = {}
    events = sorted({r[:7] for r in rows if r[2] is not None and r[4] < r[5]}, key=lambda r: (r[0], r[2], r[1], r[3], r[4], r[5]))
    for k, (s, at, path, kind, low, high, size) in enumerate(events):
        if kind != "read":
            continue
        same = [(i, e) for i, e in enumerate(events) if e[0] == s and e[2] == path]
        fresh = repeated = back = stale = 0
        for line in range(low, high):
            before = [e for i, e in same if i < k and e[4] <= line < e[5]]
            fresh += not before
            repeated += bool(before) and before[-1][3] == "read"
            back += bool(before) and before[-1][3] == "write"
            stale += any(i > k and e[3] == "write" and e[4] <= line < e[5] for i, e in same)
        n = high - low
        verdict = "repeated" if repeated == n else "written_back" if back == n else "fresh" if fresh == n else "mixed"
        out[s, path, at, low, high] = (fresh, repeated, back, stale, size * repeated // n, size * back // n, size * stale // n, verdict)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    rows = sorted(set(made(seed)), key=str)
    events = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = R.audited_reads(events).cache()
    assert {(r.session, r.path, r["at"], r.low, r.high): (r.fresh, r.repeated, r.written_back, r.stale, r.repeated_bytes, r.written_back_bytes, r.stale_bytes, r.verdict) for r in got.collect()} == plain_audit(rows)
    assert sum(r.reads for r in R.read_report(got, "session").collect()) == got.count()
    assert R.audited_reads(events.limit(0)).count() == 0


def plain_mature(rows, quiet, hold, ends):
    """A turn at a time."""
    out = {}
    for s, end in ends.items():
        own = [(r[1], r[2], r[3]) for r in rows if r[0] == s and r[2] is not None]
        for at, path, kind in own:
            if kind != "read":
                continue
            when = None
            for now in range(at, end + 1):
                last = max(t for t, p, _ in own if p == path and t <= now)
                # a touch at the moment of quiet comes too late
                if now - last >= quiet or now - at >= hold or any(t == now and now - max([u for u, q, _ in own if q == path and u < now], default=now) >= quiet for t, p, _ in own if p == path and now > at):
                    when = now
                    break
            out[s, path, at] = when
    return out


@pytest.mark.parametrize(("quiet", "hold"), [(5, 20), (9, 12), (100, 1000)])
def test_maturing(spark, quiet, hold):
    rows = made(3)
    ends = {s: max(r[1] for r in rows if r[0] == s) for s in "abcd"}
    events = spark.createDataFrame(rows, SCHEMA)
    got = {(r.session, r.path, r["at"]): r.matures for r in R.matured_reads(events, quiet, hold, spark.createDataFrame(list(ends.items()), "session string, end long")).collect()}
    assert got == plain_mature(rows, quiet, hold, ends)


def test_stream_equals_batch(spark):
    rows = sorted({r for r in made(4) if r[2] is not None}, key=lambda r: r[1])
    folder = tempfile.mkdtemp(prefix="spark-tokenloom-")
    events = spark.createDataFrame(rows, SCHEMA).select("session", "path", F.timestamp_seconds(F.col("at") * 60).alias("ts"), "kind")
    for low in range(0, 180, 30):  # files in order of time
        events.where((F.unix_seconds("ts") >= low * 60) & (F.unix_seconds("ts") < (low + 30) * 60)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = spark.createDataFrame([("zz", "q", 10_000, "write")], "session string, path string, m long, kind string").select("session", "path", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "kind")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = spark.conf.get(S.STORE[0])
    try:
        got = {(r.session, r.path, r["at"].timestamp(), r.matures.timestamp()) for r in drained(S.maturing(stream, "5 minutes", "20 minutes", "10 minutes"), "append").collect()}
    finally:
        spark.conf.set(S.STORE[0], before)
    batch = R.matured_reads(spark.createDataFrame(rows, SCHEMA), 5, 20, spark.createDataFrame([(s, 9999) for s in "abcd"], "session string, end long")).distinct()
    assert got == {(r.session, r.path, r["at"] * 60.0, r.matures * 60.0) for r in batch.collect()}


@pytest.mark.parametrize("until", [0, 40, 90, 10_000])
def test_many_files_in_a_state(until):
    """A state holds the files of many sessions; what matures and what is held of each is its own."""
    rows = [r for r in made(5) if r[2] is not None]
    touches = pd.DataFrame([(r[0], r[2], r[1], r[3] == "read") for r in rows], columns=["session", "path", "at", "is_read"])
    out, left, due = S._Holder(5, 20)._mature(touches, until)
    want = {k: v for k, v in plain_mature(rows, 5, 20, {s: 300 for s in "abcd"}).items() if v is not None}
    ms = lambda c: [int(x.timestamp() * 1000) for x in c]
    got = {(s, p, a): m for s, p, a, m in zip(out["session"], out["path"], ms(out["at"]), ms(out["matures"]), strict=True)}
    assert got == {k: v for k, v in want.items() if v <= until}
    later = [v for v in want.values() if v > until]
    assert due == (min(later) if later else None) and bool(len(left)) == bool(later)
    again, _, _ = S._Holder(5, 20)._mature(left, 10_000) if len(left) else (out[:0], None, None)
    assert {(s, p, a): m for s, p, a, m in zip(again["session"], again["path"], ms(again["at"]), ms(again["matures"]), strict=True)} == {k: v for k, v in want.items() if v > until}
