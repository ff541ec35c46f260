"""Diffs against a plain reader and reducer."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tokenloom.operators import diffs

COMBINED = "commit abc\n\ndiff --cc m.py\nindex 1,2..3\n--- a/m.py\n+++ b/m.py\n@@@ -1,2 -1,2 +1,3 @@@ def f\n  x\n- y\n -z\n++w\n"
RENAMED = "diff --git a/o.py b/n.py\nsimilarity index 95%\nrename from o.py\nrename to n.py\nindex 1a..2b 100755\n--- a/o.py\n+++ b/n.py\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file"
BINARY = "diff --git a/i.png b/i.png\nnew file mode 100644\nindex 0..1\nBinary files /dev/null and b/i.png differ\ndiff --git a/d b/d\ndeleted file mode 100755\n--- a/d\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- sql comment\n-x"


def made(seed, n_files, n_hunks, size=9):
    rng = random.Random(seed)
    out = ["From: someone", ""] if seed % 2 else []
    for f in range(n_files):
        out += [f"diff --git a/f{f}.py b/f{f}.py", "index aa..bb 100644", f"--- a/f{f}.py", f"+++ b/f{f}.py"]
        for h in range(n_hunks):
            out.append(f"@@ -{h * 20 + 1},9 +{h * 20 + 1},9 @@")
            out += [rng.choice(["+", "-", " ", " ", " ", " ", " ", "\\ "]) + rng.choice(["alpha", "an error here", "beta", "token", ""]) for _ in range(rng.randrange(size))]
    return "\n".join(out)


TEXTS = [COMBINED, RENAMED, BINARY, "", None, "no diff\n" * 60, made(1, 25, 3), made(2, 3, 14), made(3, 1, 30, 25), made(5, 30, 1), made(6, 2, 12, 1), made(7, 1, 2), "diff --git a/x b/x", made(8, 1, 12, 12).replace("\n", "\r\n")]
FILE, HUNK = re.compile(r"(?s)^diff --(git a/.+ b/.+|combined .+|cc .+)\Z"), re.compile(r"^(@{2,})( -\d+(,\d+)?)+ \+\d+(,\d+)? \1")
INDEX = re.compile(r"^index [0-9a-f]+(,[0-9a-f]+)*\.\.[0-9a-f]+( [0-7]+)?\Z")


def plain_parse(text):
    pre, files = [], []
    for line in (text or "").split("\n"):
        if FILE.match(line):
            files.append({"header": line, "old": None, "new": None, "meta": [], "hunks": []})
        elif not files:
            pre.append(line)
        elif HUNK.match(line):
            files[-1]["hunks"].append((line, []))
        elif files[-1]["hunks"]:
            files[-1]["hunks"][-1][1].append(line)
        elif re.match(r"(?s)^--- (a/.+|/dev/null)\Z", line):
            files[-1]["old"] = line
        elif re.match(r"(?s)^\+\+\+ (b/.+|/dev/null)\Z", line):
            files[-1]["new"] = line
        else:
            files[-1]["meta"].append(line)
    return pre, files


def counts(lines):
    return sum(x[:1] == "+" for x in lines), sum(x[:1] == "-" for x in lines)


def plain_reduce(text, words=(), n_files=20, n_hunks=10, around=2):
    text = text or ""
    before = text.split("\n")
    pre, files = plain_parse(text)
    if len(before) < 50 or not files:
        return text, None
    total = lambda f: sum(sum(counts(h[1])) for h in f["hunks"])
    order = sorted(range(len(files)), key=lambda i: (-total(files[i]), i))[:n_files]
    out, added, deleted, kept, every = list(pre), 0, 0, 0, 0
    for i in sorted(order):
        f = files[i]
        m = re.match(r"(?s)^diff --git a/(.+) b/\1\Z", f["header"])
        meta = [x for x in f["meta"] if not INDEX.match(x)]
        if not (m and not meta and f["old"] == f"--- a/{m[1]}" and f["new"] == f"+++ b/{m[1]}"):
            out.append(f["header"])
        out += meta + [x for x in (f["old"], f["new"]) if x is not None]

        def score(h):
            own = "\n".join(h[1]).lower()
            urgent = any(re.search(p, own) for p in diffs.PRIORITIES)
            return round(min(1.0, min(0.3, 0.03 * sum(counts(h[1]))) + 0.3 * urgent + 0.2 * sum(len(w) > 2 and w in own for w in words)), 9)

        at = range(len(f["hunks"]))
        if len(at) > n_hunks:
            middle = sorted(at[1:-1], key=lambda k: (-score(f["hunks"][k]), k))[: n_hunks - 2]
            at = sorted({0, len(f["hunks"]) - 1, *middle})
        kept, every = kept + len(at), every + len(f["hunks"])
        for h in f["hunks"]:
            a, d = counts(h[1])
            added, deleted = added + a, deleted + d
        for k in at:
            header, lines = f["hunks"][k]
            changes = [j for j, x in enumerate(lines) if x[:1] in ("+", "-")]
            stays = {j for c in changes for j in range(c - around, c + around + 1)} | {j for j, x in enumerate(lines) if x[:1] == "\\"} if changes else set(range(around))
            out += [header, *(x for j, x in enumerate(lines) if j in stays)]
    out.append(f"[{len(order)} files changed, +{added} -{deleted} lines{f', {every - kept} hunks omitted' if every > kept else ''}]")
    if len(out) < 0.8 * len(before):
        key = hashlib.md5(text.encode()).hexdigest()[:24]
        return "\n".join([*out, f"[{len(before)} lines compressed to {len(out)}. Retrieve full diff: hash={key}]"]), key
    return "\n".join(out), None


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "id long, diff string, file int, line string").repartition(3)


def test_parse(texts):
    got = {r.id: r for r in diffs.parsed_diffs(texts, "id", "diff").collect()}
    for i, t in enumerate(TEXTS):
        pre, files = plain_parse(t)
        if not files:
            assert i not in got
            continue
        assert got[i].pre == pre
        assert [(f.header, f.old, f.new, f.meta) for f in got[i].files] == [(f["header"], f["old"], f["new"], f["meta"]) for f in files]
        assert [[(h.header, h.lines, (h.additions, h.deletions)) for h in f.hunks] for f in got[i].files] == [[(*h, counts(h[1])) for h in f["hunks"]] for f in files]
    assert [(f.is_new, f.is_binary, f.is_deleted) for f in got[2].files] == [(True, True, False), (False, False, True)]
    assert got[1].files[0].is_renamed and got[0].files[0].hunks[0].header.startswith("@@@")


@pytest.mark.parametrize("words", [None, ["beta", "TOKEN", "an"]])
def test_reduce(spark, texts, words):
    query = spark.createDataFrame([(i, words) for i in range(len(TEXTS))], "id long, words array<string>") if words else None
    got = {r.id: r for r in diffs.reduced_diffs(texts, "id", "diff", query).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].text, got[i].hash) == plain_reduce(t, [w.lower() for w in words or ()]), i
    assert got[7].hunks_dropped == 12 and got[6].files == 20


def test_index_lines(texts):
    got = {r.id: r.t for r in texts.select("id", diffs.without_index(texts["diff"]).alias("t")).collect()}
    assert got == {i: None if t is None else "\n".join(x for x in t.split("\n") if not INDEX.match(x)) for i, t in enumerate(TEXTS)}


def test_nothing(spark, texts):
    none = texts.limit(0)
    assert diffs.parsed_diffs(none, "id", "diff").count() == 0 and diffs.reduced_diffs(none, "id", "diff").count() == 0
