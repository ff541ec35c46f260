"""Folded repeats against a plain version and their inverse."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import sessions

NUMBER = re.compile(r"^( *)(0|[1-9][0-9]{0,8})([\t:|→])")


def plain_line(line):
    m = NUMBER.match(line)
    if not m:
        return None, (-1, line)
    return int(m[2]), (len(m[1] + m[2]) if m[1] else 0, line[len(m[1] + m[2]) :])


def plain_fold(texts, least, least_chars, protected):
    """The rule, one session, block by block."""
    lines = [t.split("\n") for t in texts]
    found = [[plain_line(x) for x in own] for own in lines]

    def windows(b):
        out = {}
        for n in range(len(found[b]) - least + 1):
            nums, bodies = zip(*found[b][n : n + least], strict=True)
            base = next((x for x in nums if x is not None), None)
            key = (bodies, tuple(None if x is None else x - base for x in nums))
            out.setdefault(key, []).append((n, base))
        return out

    kinds, seen, result = [windows(b) for b in range(len(texts))], {}, []
    for b in range(len(texts)):
        diagonals = {}
        for key, places in kinds[b].items():
            if key in seen:
                of, source = seen[key]
                for i, (n, base) in enumerate(places):
                    m, other = source[min(i, len(source) - 1)]
                    diagonals.setdefault((of, n - m, (base or 0) - (other or 0)), []).append(n)
        for key, places in kinds[b].items():
            seen.setdefault(key, (b, places))
        best = {}
        for (of, diagonal, shift), places in diagonals.items():
            places.sort()
            cuts = [0, *[i for i in range(1, len(places)) if places[i] - places[i - 1] > least], len(places)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                low, high = places[i], places[j - 1] + least
                for n in range(low, high):
                    best[n] = max(best.get(n, ()), (high - low, -low, -of, diagonal, shift))
        spans = {}
        for n, by in best.items():
            spans.setdefault(by, []).append(n)
        folds = {}
        for (_, _, old, diagonal, shift), own in spans.items():
            low, high = min(own), max(own) + 1
            text = "\n".join(lines[b][low:high])
            mark = f"[[{high - low} lines of block {-old} from {low - diagonal + 1}, numbers {shift:+d}]]"
            if high - low >= least and len(text) >= least_chars and len(mark) < len(text):
                folds[low] = (high, mark)
        out, n = [], 0
        while n < len(lines[b]):
            if n in folds:
                out.append(folds[n][1])
                n = folds[n][0]
            else:
                out.append("\\" + lines[b][n] if re.match(r"\\*\[\[[0-9]+ lines of block ", lines[b][n]) else lines[b][n])
                n += 1
        result.append(texts[b] if protected[b] else "\n".join(out))
    return result


def made(seed):
    rng = random.Random(seed)
    pool = [f"line {k} of the file with some words" for k in range(30)] + ["", "x", "[[3 lines of block 0 from 1, numbers +0]]", "\\[[3 lines of block 0", "{", "}", "}", "end\r", "[[3 lines of block 0 from 1, numbers +0]]\r"]
    rows = []
    for s in ("a", "b"):
        base = [rng.choice(pool) for _ in range(40)]
        for t in range(14):
            low = rng.randrange(30)
            own = base[low : low + rng.randrange(3, 25)]
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = "edited"
            first, style = rng.choice([1, 8, 95, 997]), rng.choice(["", "{:>6}\t", "{}:", "{:>4}→"])
            rows.append((s, t, "\n".join((style.format(first + k) if style else "") + x for k, x in enumerate(own)), "c", 1))
    rows += [("a", None, "\n".join(["same same same same"] * 50), "c", 1), ("a", 20, "\n".join(["same same same same"] * 45), "c", 1), ("a", 20, "\n".join(["same same same same"] * 45), "c", 1), ("b", 30, None, "c", 1), ("b", 31, "", "c", 1), (None, 1, "q\n" * 40, "c", 1), (None, 2, "q\n" * 40, "c", 1), ("c", 1, "alone", "c", 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "s string, t int, x string, session string, block int"


@pytest.mark.parametrize(("seed", "least", "least_chars"), [(1, 3, 40), (2, 2, 10), (3, 5, 1)])
def test_fold(spark, seed, least, least_chars):
    rows = made(seed)
    found = sessions.blocks(spark.createDataFrame(rows, SCHEMA).repartition(3), "s", "t", "x", F.col("t") == 6).cache()
    folded = sessions.fold_repeats(found, least, least_chars).cache()
    got = {(r.session, r.block): r for r in folded.collect()}
    assert len(got) == len(rows) and any(r.spans for r in got.values())
    for s in ("a", "b", "c"):
        own = sorted(((t is not None, t or 0, x or "") for k, t, x, *_ in rows if k == s))
        want = plain_fold([x for *_, x in own], least, least_chars, [t == 6 and has for has, t, _ in own])
        assert [got[s, b].text for b in range(len(own))] == want
    original = {(r.session, r.block): r.text for r in found.collect()}
    for r in got.values():
        assert len(original[r.session, r.block]) - len(r.text) <= r.chars and r.chars >= 0
    assert {(r.session, r.block): r.text for r in sessions.unfold_repeats(folded.where("block != 99")).collect()} == {k: v for k, v in original.items()}
    assert sessions.changed_by_later_turns(found, 9, least, least_chars).count() == 0


def test_nothing(spark):
    none = sessions.blocks(spark.createDataFrame([], SCHEMA), "s", "t", "x")
    assert sessions.fold_repeats(none).count() == 0 and sessions.unfold_repeats(sessions.fold_repeats(none)).count() == 0


def test_only_places_go_through_the_rounds(spark, tmp_path, monkeypatch):
    """Lines are written once, however many rounds a chain of pointers takes."""
    monkeypatch.setattr(sessions, "shared_folder", lambda _: f"file://{tmp_path}")
    chain = ["one line of text\nanother line\n  12\tthird"] + [f"[[3 lines of block {k} from 1, numbers +1]]" for k in range(9)]
    folded = spark.createDataFrame([("s", k, k, False, x) for k, x in enumerate(chain)], "session string, block long, turn long, protected boolean, text string")
    got = {r.block: r.text for r in sessions.unfold_repeats(folded).collect()}
    assert got == {k: f"one line of text\nanother line\n  {12 + k}\tthird" for k in range(10)}
    written = {p.name: spark.read.parquet(str(p)).columns for p in tmp_path.glob("*/*")}
    assert len(written) > 3 and [n for n, c in written.items() if "line" in c] == ["rows"]
