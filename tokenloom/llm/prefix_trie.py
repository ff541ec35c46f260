"""The prefix trie of conversations: what a cache of shared beginnings would hold and save.

A node is a distinct sequence of first turns; the root has none.  Turns are 16 bytes of the SHA-256 of their role and text, so texts
are read once and never shuffled.

Conversations are dealt into shards by ranges of their sequences.  A shard numbers its distinct turns in order and builds a
ternary search tree over these numbers; its sequences are inserted median first, which keeps the tree balanced.  The tree's nodes
are then passed once, children before parents, to add up members, leaves and savings.  A node whose subtree lies in
one shard is done.  The others are beginnings of the shard's first or last sequence: these two come out as
rows with what their nodes have so far, and are merged by the same shards over such rows, a small part
of those before, until one shard holds them all.

A task holds a shard, some ``SHARD`` turns on average, and so a conversation's turns at some 100 bytes each.  A sequence that many
conversations share is cut by conv_id and spread over shards; so is the list of conversations that end at one node, which is
hashed in the end by one task that reads it piece by piece, as a digest of one string has to be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.llm.scratch import Scratch

#: Turns and conversations of a shard on average, and rows at least.
SHARD, LEAST_ROWS = 10_000, 8
#: Kinds of rows that a shard gives: nodes, beginnings to be merged, conversations that end at one.
NODE, OPEN, ENDS = range(3)
_OWN = "own array<struct<members:long,least:long,children:long,leaves:long,saved:long>>"
_NODE = "conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary"
_ROW = f"kind int, shard int, {_NODE}, keys array<binary>, chars array<long>, {_OWN}, ids binary"
_ARROW_OWN = pa.list_(pa.struct([(c, pa.int64()) for c in ("members", "least", "children", "leaves", "saved")]))
_ARROW = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("up", pa.binary())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("node", pa.binary()), ("keys", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64())), ("own", _ARROW_OWN), ("ids", pa.binary())]
)


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, keys, chars``: each conversation's turns in order, and the code points of their texts.

    Turns ascend, null first; equal ones by what they hold.  Null roles and texts count as empty.  Rows without conv_id are turns of
    no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_key(role, text).alias("key"), F.length(text).cast("long").alias("chars")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.key").alias("keys"), F.col("t.chars").alias("chars"))


class SearchTree:
    """A ternary search tree over whole numbers: a node for each distinct beginning, node 0 for the empty one."""

    def __init__(self) -> None:
        self.mark, self.depth, self.parent, self.children = [-1], [0], [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def _new(self, mark: int, parent: int) -> int:
        for values, v in ((self.mark, mark), (self.depth, self.depth[parent] + 1), (self.parent, parent), (self.children, 0), (self.low, -1), (self.high, -1), (self.down, -1)):
            values.append(v)
        self.children[parent] += 1
        return len(self.mark) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes of all beginnings of ``sequence``, shortest first."""
        path = [0]
        for mark in sequence:
            above, at, side = path[-1], self.down[path[-1]], self.down
            last = above
            while at >= 0 and self.mark[at] != mark:
                last, side = at, self.low if mark < self.mark[at] else self.high
                at = side[at]
            if at < 0:
                at = self._new(mark, above)
                side[last] = at
            path.append(at)
        return path


def median_first(n: int) -> Iterator[int]:
    """The numbers below ``n``, each range's middle before its halves."""
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(middle + 1, high), (low, middle)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[list[int]], list[bytes], list[int], list, list]:
    """The rows' sequences as numbers, the turns that they number in order, their code points, conv_ids and what nodes have so far."""
    keys, chars, convs, own = [], [], [], []
    for batch in batches:
        keys.append(batch.column("keys"))
        chars.append(batch.column("chars").flatten())
        convs += batch.column("conv_id").to_pylist()
        own += batch.column("own").to_pylist()
    if not convs:
        return [], [], [], [], []
    encoded = pa.concat_arrays([k.flatten() for k in keys]).dictionary_encode()
    turns = encoded.dictionary.to_pylist()
    order = sorted(range(len(turns)), key=turns.__getitem__)
    rank = np.empty(len(turns), dtype=np.int64)
    rank[order] = np.arange(len(turns))
    flat = rank[encoded.indices.to_numpy()] if turns else np.zeros(0, dtype=np.int64)
    points = np.zeros(len(turns), dtype=np.int64)
    points[flat] = pa.concat_arrays(chars).to_numpy()
    ends = np.cumsum(np.concatenate([k.value_lengths().to_numpy() for k in keys])).tolist()
    numbers = flat.tolist()
    return [numbers[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], [turns[i] for i in order], points.tolist(), convs, own


def _shard(level: int, last: bool):
    """Rows of a range of sequences, in order -> its nodes, and what has to be merged with other shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns, points, convs, own = _gathered(batches)
        if not rows:
            return
        shard = TaskContext.get().partitionId()
        begins = [k for k in range(len(rows)) if not k or rows[k] != rows[k - 1]]
        stops = [*begins[1:], len(rows)]
        tree, paths = SearchTree(), [[]] * len(begins)
        for k in median_first(len(begins)):
            paths[k] = tree.insert(rows[begins[k]])
        n = len(tree.mark)
        members, least, closed, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
        ids: dict[int, list[int]] = {}

        def add(node: int, count: int, smallest: int | None) -> None:
            members[node] += count
            if smallest is not None and (least[node] is None or smallest < least[node]):
                least[node] = smallest

        for path, low, high in zip(paths, begins, stops, strict=True):
            for k in range(low, high):
                for node, x in zip(path, own[k] or (), strict=False):
                    add(node, x["members"], x["least"])
                    closed[node] += x["children"]
                    leaves[node] += x["leaves"]
                    saved[node] += x["saved"]
            if own[low] is None:
                ids[path[-1]] = convs[low:high]
                add(path[-1], high - low, convs[low])
        shared = set() if last else {*paths[0], *paths[-1]}
        digests = {0: hashlib.sha256().digest()}
        if level or shared:  # a node's parent has a smaller number
            for node in range(1, n) if level else sorted(shared - {0}):
                digests[node] = hashlib.sha256(digests[tree.parent[node]] + turns[tree.mark[node]]).digest()
        none = hashlib.sha256().hexdigest()
        out: dict[str, list] = {c: [] for c in _ARROW.names}

        def emit(**values) -> None:
            for c, column in out.items():
                column.append(values.get(c))

        done, totals = [], {}
        for node in range(n - 1, -1, -1):
            if node in shared:
                continue
            above, count = tree.parent[node], tree.children[node] + closed[node]
            sums = leaves[node] if count else 1, saved[node] + (members[node] - 1) * (points[tree.mark[node]] if node else 0)
            totals[node] = (count, *sums)
            done.append(node)
            if node:
                add(above, members[node], least[node])
                leaves[above] += sums[0]
                saved[above] += sums[1]
                if above in shared:
                    closed[above] += 1
        for node in done:
            above = tree.parent[node]
            count, n_leaves, total = totals[node]
            ended = None if level else hashlib.sha256(",".join(map(str, ids[node])).encode()).hexdigest() if node in ids else none
            emit(
                kind=NODE, shard=shard, conv_id=least[node], depth=tree.depth[node], parent_conv_id=least[above] if node and above not in shared else None, up=digests[above] if node and above in shared else None,
                n_convs=members[node], n_children=count, n_leaves=n_leaves, saved_tokens=total, ends_sha256=ended, node=digests[node] if level else None,
            )
        given: set[int] = set()
        for path in [paths[0], paths[-1]][: min(2, len(paths))] if shared else []:
            parts = [{"members": members[x], "least": least[x], "children": closed[x], "leaves": leaves[x], "saved": saved[x]} if x not in given else dict.fromkeys(("members", "children", "leaves", "saved"), 0) for x in path]
            given |= {*path}
            emit(kind=OPEN, shard=shard, keys=[turns[tree.mark[x]] for x in path[1:]], chars=[points[tree.mark[x]] for x in path[1:]], own=parts)
        for node in sorted(shared & ids.keys()):
            emit(kind=ENDS, shard=shard, node=digests[node], ids=",".join(map(str, ids[node])).encode())
        yield from pa.Table.from_pydict(out, schema=_ARROW).to_batches(max_chunksize=10_000)

    return build


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists, those of a node in order -> the digest of each node's whole list."""
    node, state = None, hashlib.sha256()
    found: tuple[list, list] = [], []
    for batch in batches:
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if own != node:
                if node is not None:
                    found[0].append(node)
                    found[1].append(state.hexdigest())
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*found[0], node], type=pa.binary()), pa.array([*found[1], state.hexdigest()])], names=["node", "ended"])


def prefix_nodes(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``rows(conv_id, keys, chars)`` has each conversation once; one without turns is a member of the root and ends there.  conv_id and
    parent_conv_id are the smallest members of the node and its parent (null for the root); leaves are nodes without children in the
    subtree, savings are (members - 1) times the last text's code points, summed over the subtree; the digest is of
    the conv_ids that end at the node, ascending and joined by commas.  No conversations give no nodes.
    """
    scratch = Scratch(rows.sparkSession, "prefix-trie")
    level, found, ended = 0, [], None
    open_rows = scratch.save(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "keys", F.col("chars").cast("array<long>").alias("chars"), F.lit(None).cast(_OWN.removeprefix("own ")).alias("own")), "sequences")
    while True:
        size = open_rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("keys") + 1), F.lit(0)).alias("turns")).first()
        shards = min(-(-size["turns"] // shard), size["rows"] // LEAST_ROWS)
        last = shards < 2
        dealt = open_rows.repartition(1) if last else open_rows.repartitionByRange(shards, "keys", "conv_id")
        made = scratch.save(dealt.sortWithinPartitions("keys", "conv_id").mapInArrow(_shard(level, last), _ROW), f"level-{level}")
        found.append(made.where(F.col("kind") == NODE).withColumn("level", F.lit(level)))
        if not level:
            pieces = made.where(F.col("kind") == ENDS).select("node", "shard", "ids").repartition("node").sortWithinPartitions("node", "shard")
            ended = pieces.mapInArrow(_list_digests, "node binary, ended string")
        if last:
            break
        open_rows, level = made.where(F.col("kind") == OPEN).select("conv_id", "keys", "chars", "own"), level + 1
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not level:
        return found[0].select(*names)
    merged = found[1]
    for more in found[2:]:
        merged = merged.union(more)
    merged = scratch.save(merged.join(ended, "node", "left").withColumn("ends_sha256", F.coalesce("ended", F.lit(hashlib.sha256().hexdigest()))), "merged")
    every = found[0].select("level", "shard", "up", *names).union(merged.select("level", "shard", "up", *names))
    # a shard's open nodes are few: they meet their merged selves first, then the shard's own rows
    asked = every.where("up IS NOT NULL").select("level", "shard", "up").distinct()
    above = scratch.save(asked.join(merged.select(F.col("node").alias("up"), F.col("conv_id").alias("above")), "up"), "open-parents")
    known = every.where("up IS NULL").select(*names)
    rest = every.where("up IS NOT NULL").drop("parent_conv_id").join(above, ["level", "shard", "up"]).withColumnRenamed("above", "parent_conv_id")
    return known.union(rest.select(*names))
