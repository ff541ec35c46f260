"""Merkle manifests and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import merkle
from tokenloom.llm.line_dedup import without_common_lines
from tokenloom.llm.queries import op11_merkle, op13_line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, path string, n_lines int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(*fields):
    return "".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields)


def plain_tree(leaves, arity):
    """The root and each leaf's (left, right) siblings, by recursion over runs."""
    paths = [[] for _ in leaves]
    owners = [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(k, min(k + arity, len(leaves))) for k in range(0, len(leaves), arity)]
        for run in runs:
            for k in run:
                for leaf in owners[k]:
                    paths[leaf].append(("".join(leaves[j] for j in run if j < k), "".join(leaves[j] for j in run if j > k)))
        owners = [[x for k in run for x in owners[k]] for run in runs]
        leaves = [sha(*(leaves[k] for k in run)) for run in runs]
    return leaves[0], paths


def plain_manifest(rows, arity=3):
    """(doc_id, leaf, subroot, root, path) of rows, as the contract has it."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, sha(encoded(r[0], r[3], r[2], r[4], r[1]))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s])], arity) for s in names]
    root, above = plain_tree([t[0] for t in trees], arity)
    out = []
    for k, s in enumerate(names):
        for (has, doc, leaf), path in zip(sorted(groups[s]), trees[k][1], strict=True):
            out.append((doc if has else None, leaf, trees[k][0], root, path + above[k]))
    return out


def made(spark, n, sources, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "a\nb", "é\n\n", "plain", "\n"]
    rows = [(k, rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3, -7]), 1, "p", 2) for k in range(n)]
    rows += [rows[0], rows[0], (None, "x", None, sources[0], None, 0, "", 0), (None, "y\n", None, sources[0], None, 0, "", 0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def leaves_of(docs):
    return docs.withColumn("leaf", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))


@pytest.mark.parametrize(("n", "arity", "sources"), [(40, 3, ["b", "a", None, "B", "é"]), (41, 2, ["z"]), (30, 5, [str(k) for k in range(25)]), (1, 3, ["one"])])
def test_manifest(spark, n, arity, sources):
    rows, docs = made(spark, n, sources)
    got = merkle.manifest(leaves_of(docs), "source", ["doc_id"], arity).collect()
    plain = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), [(p.l.hex(), p.r.hex()) for p in r.path]) for r in got]
    assert sorted(map(str, plain)) == sorted(map(str, plain_manifest(rows, arity)))
    assert got[0].asDict()["i"] is not None and {r.n_lines for r in got} <= {0, 2}


def test_merkle_query(spark, tmp_path):
    rows, docs = made(spark, 60, ["b", "a", None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in rows]
    got = sorted(str(tuple(r)) for r in op11_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    by_leaf = {}
    for r in rows:
        text = r[1] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[1] is None else r[1].replace("\n", "")
        by_leaf[sha(encoded(r[0], r[3], r[2], r[4], r[1]))] = sha(encoded(r[0], r[3], r[2], r[4], text))
    want = []
    for doc, leaf, subroot, root, path in plain_manifest(rows):
        own = by_leaf[leaf]
        for left, right in path:
            own = sha(left, own, right)
        want.append(str((doc, leaf, subroot, root, sha(*(x for p in path for x in p)), own, own == root)))
    assert got == sorted(want)
    assert {w.rsplit(" ", 1)[1] for w in want} == {"True)", "False)"}


def test_merkle_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = merkle.manifest(leaves_of(none), "source", ["doc_id"])
    assert out.count() == 0 and {"subroot", "root", "path", "leaf"} <= set(out.columns)


BLANK = " \t\n\x0b\x0c\r"


def plain_lines(rows, at_least, least_chars):
    keys = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANK)) for x in (t or "").split("\n")]
    seen = {}
    for k, r in enumerate(rows):
        for key in set(keys(r[1])):
            seen.setdefault(key, set()).add(("row", k, keys(r[1]).count(key)) if r[0] is None else r[0])
    count = {k: sum(x[2] if isinstance(x, tuple) else 1 for x in v) for k, v in seen.items()}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, key in zip(lines, keys(r[1]), strict=True) if len(key) < least_chars or count[key] < at_least]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("at_least", "least_chars", "head"), [(3, 1, 10_000), (3, 1, 1), (2, 2, 0), (4, 0, 2)])
def test_lines(spark, at_least, least_chars, head):
    rng = random.Random(at_least)
    pool = ["Common Line", " common line\t", "É", "é", "", " ", "x", "X\r", "rare", " padded", "common  line", "1", "zwei\x0b"]
    rows = [(k, "\n".join(rng.choice([*pool, f"own {rng.random()}"]) for _ in range(rng.randrange(9))), None, "s", 1, 2, "p", 7) for k in range(40)]
    rows += [(100, None, None, None, None, 0, "", 0), (101, "", None, None, None, 0, "", 0), (None, "twice\nTwice\ntwice", None, None, None, 0, "", 0), (5, rows[5][1], None, "s", 1, 2, "p", 7), (5, "rare\nrare", None, None, None, 0, "", 0), (102, "\n" * 5000 + "tail", None, None, None, 0, "", 0), (103, "only here", None, "s", 1, 1, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = without_common_lines(docs, at_least, least_chars, head)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in got.collect()) == sorted(str(x) for x in plain_lines(rows, at_least, least_chars))


def test_lines_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert without_common_lines(none).count() == 0
    assert op13_line_dedup(spark, str(tmp_path)).count() == 0


def test_line_dedup_is_native(spark, sf):
    plan = op13_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op11_merkle", "op13_line_dedup"])
def test_same_rows_as_sql(spark, sf, name):
    import duckdb

    from tokenloom.llm.queries import QUERIES, SQL

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert got == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
