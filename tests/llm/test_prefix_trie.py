"""The prefix trie against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tokenloom.llm.prefix_trie import SearchTree, median_first, prefix_nodes, sequences
from tokenloom.llm.queries import op12_prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, keys string, level int"


def plain_conversations(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in own.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    ends = {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves = sum(sums[k][0] for k in kids) or 1
        saved = sum(sums[k][1] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = (leaves, saved)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, digest))
    return sorted(map(str, out))


def collected(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r)) for r in df.collect())


def made(n, seed):
    rng = random.Random(seed)
    texts = ["a", "", None, "é漢", "b\nc", "long " * 9]
    rows = []
    for c in range(n):
        rows += [(c * 3 - 60, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(texts), "k", 1) for t in range(rng.randrange(1, 7))]
    rows += [(1000 + c, t, "user", f"t{t}", "k", 1) for c in range(60) for t in range(4)]  # one sequence, many times
    rows += [(5000 + c, t, "user", "same", "k", 1) for c in range(3) for t in range(700 + c)]  # deep
    rows += [rows[0], (None, 0, "user", "nobody", "k", 1), (7000, 0, None, None, "k", 1), (7000, 0, "b", "a", "k", 1), (7000, 0, "a", "b", "k", 1), (7100, 0, "u", "x", "k", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "seed"), [(60, 1), (400, 2), (10_000, 3)])
def test_nodes(spark, shard, seed):
    rows = made(60, seed)
    convs = plain_conversations(rows)
    own = sequences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert collected(prefix_nodes(own, shard)) == plain_nodes(convs)


def test_query(spark, tmp_path):
    rows = made(80, 5)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = plain_rebuilt(plain_conversations(rows))
    assert any(not t for t in convs.values())
    assert collected(op12_prefix_trie(spark, str(tmp_path))) == plain_nodes(convs)
    assert collected(prefix_nodes(rebuilt(sequences(spark.read.parquet(f"{tmp_path}/conversations.parquet"))), 50)) == plain_nodes(convs)


def test_nothing(spark):
    assert prefix_nodes(sequences(spark.createDataFrame([], SCHEMA))).count() == 0
    assert prefix_nodes(sequences(spark.createDataFrame([(None, 1, "user", "x", "k", 1)], SCHEMA))).count() == 0


def test_search_tree_is_balanced():
    assert sorted(median_first(1000)) == list(range(1000))
    tree = SearchTree()
    for k in median_first(1023):
        assert tree.insert([k])[1:] == tree.insert([k])[1:]
    height, level = 0, [tree.down[0]]
    while level:
        height += 1
        level = [x for at in level for x in (tree.low[at], tree.high[at]) if x >= 0]
    assert height == 10 and tree.children[0] == 1023


def test_same_rows_as_sql(spark, sf):
    import duckdb

    from tokenloom.llm.queries import SQL

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = duck.execute(SQL["op12_prefix_trie"])
    names = [d[0] for d in cursor.description]
    df = op12_prefix_trie(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert collected(df) == sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in cursor.fetchall())
