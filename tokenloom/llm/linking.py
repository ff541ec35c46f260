"""Confirmed links between sets that share a bucket, without emitting all pairs of a bucket.

Buckets come from MinHash bands.

1. Every member of a bucket is compared with the bucket's centre, the member that collides most over all its
   buckets.  Copies with edits of their own lie around the text they were made from: where two of them are
   similar enough, either is similar enough to the one with the fewest edits.  Confirmed links make components.
2. Buckets whose members are by then all in one component cannot add anything.  In the others every pair of
   different components whose sizes leave the threshold possible is compared: as rows in buckets of ``HOT`` members
   at most, else inside tasks, where slabs of all members meet blocks of those outside the bucket's largest component and
   only links that join components leave the task.

All candidates are confirmed on full sets, so no false link is made.  Every pair of a bucket whose ends stay in different
components has been compared, whatever the size of the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import connected_components
from tokenloom.llm.scratch import Scratch

#: Members of a bucket beyond which they are compared inside tasks and not as rows.
HOT = 32
#: Tables are written by so many tasks and one more for each so many band keys.
LEAST_TASKS, KEYS_A_TASK = 12, 1_000_000
#: Expected members of a bucket, expected ones of them outside its largest component, and shingles of either that meet in a task.
SLAB, BLOCK, SHINGLES = 4096, 1024, 4_000_000


def _least_agreement(size: int, numerator: int, denominator: int) -> int:
    """Of ``size`` independent coordinates a pair at the threshold has fewer in common than this once in 1e9 at most."""
    p, tail = numerator / denominator, 0.0
    for n in range(size):
        tail += math.comb(size, n) * p**n * (1 - p) ** (size - n)
        if tail > 1e-9:
            return n
    return size


def _agreement(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c)) for c in ("sig_a", "sig_b"))
            mask = (a == b).sum(axis=1) >= _least_agreement(a.shape[1], numerator, denominator) if len(a) else np.zeros(0, dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(mask))

    return keep


def _matrix(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    n = len(column)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(n, -1) if n else np.zeros((0, 1), dtype=np.uint8)


def _confirm(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs with denominator * |A & B| >= numerator * |A | B|."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")  # two sorted runs: one merge
                shared = int((both[1:] == both[:-1]).sum())
                mask.append(denominator * shared >= numerator * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(mask, type=pa.bool_()))

    return keep


def _links(edges: DataFrame, sets: DataFrame, ratio: tuple[int, int], scratch: Scratch, name: str, tasks: int) -> DataFrame:
    """The confirmed ones of candidate ``edges(a, b)``.

    Signatures are compared first, for they are a fiftieth of the sets' bytes.  The agreement asked for depends on
    their length, so that a pair at the threshold falls short of it once in 1e9 whatever it is.
    """
    num, den = ratio
    size = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    short = sets.select("cid", "n", "sig")
    near = (
        edges.join(short.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        .join(short.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
        .where(size)
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_agreement(num, den), edges.select("a", "b").schema)
    )
    both = (
        near.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a")
        .select("a", "b", "set_a", "set_b")
    )
    return scratch.save(both.mapInArrow(_confirm(num, den), edges.select("a", "b").schema), name, tasks)


def _close(numerator: int, denominator: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links between the users of a block and those outside its bucket's largest component: a spanning forest of them.

    Every pair of different components is compared on full sets in the first bucket that it shares, unless the sizes, the
    signatures or links found before it in this block make that needless.
    """

    def pairs(users: pa.Table, outside: pa.Table) -> pa.Table:
        users, outside = users.combine_chunks(), outside.combine_chunks()
        found_a: list[bytes] = []
        found_b: list[bytes] = []
        if len(users) and len(outside):
            band = users["band"][0].as_py()
            sig_a, sig_b = (_matrix(t["sig"].chunk(0)) for t in (users, outside))
            keys_a, keys_b = (np.array(t["keys"].chunk(0).flatten()).reshape(len(t), -1)[:, :band] for t in (users, outside))
            n_a, n_b = (t["n"].to_numpy() for t in (users, outside))
            comps = pa.concat_arrays([users["comp"].chunk(0), outside["comp"].chunk(0)]).dictionary_encode().indices.to_numpy()
            label = np.arange(comps.max() + 1)
            comp_a, comp_b = comps[: len(users)], comps[len(users) :]
            main, cid_a, cid_b = users["comp_is_main"].to_numpy(), users["cid"].to_pylist(), outside["cid"].to_pylist()
            order = {c: i for i, c in enumerate(sorted({*cid_a, *cid_b}))}
            rank_a, rank_b = (np.array([order[c] for c in x]) for x in (cid_a, cid_b))
            least = _least_agreement(sig_a.shape[1], numerator, denominator)
            values = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in users["shingles"].chunk(0)])
            owner = np.repeat(np.arange(len(users)), n_a)
            by = np.argsort(values, kind="stable")
            owner, (values, begin, uses) = owner[by], np.unique(values[by], return_index=True, return_counts=True)
            for j, own in enumerate(outside["shingles"].chunk(0)):
                fits = denominator * np.minimum(n_a, n_b[j]) >= numerator * np.maximum(n_a, n_b[j])
                rows = np.flatnonzero(fits & (label[comp_a] != label[comp_b[j]]) & (main | (rank_a < rank_b[j])))  # two users outside meet twice
                rows = rows[(sig_a[rows] == sig_b[j]).sum(axis=1) >= least]
                rows = rows[~(keys_a[rows] == keys_b[j]).any(axis=1)]
                if not len(rows):
                    continue
                asked = np.frombuffer(own.as_buffer(), dtype=np.uint64)
                place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                place = place[values[place] == asked]
                n = uses[place]
                at = np.arange(n.sum()) + np.repeat(begin[place] - (np.cumsum(n) - n), n)
                shared = np.bincount(owner[at], minlength=len(users))[rows]
                for i in rows[denominator * shared >= numerator * (n_a[rows] + n_b[j] - shared)].tolist():
                    if label[comp_a[i]] != label[comp_b[j]]:
                        label[label == label[comp_a[i]]] = label[comp_b[j]]
                        found_a.append(cid_a[i])
                        found_b.append(cid_b[j])
        return pa.table({"a": pa.array(found_a, type=pa.binary()), "b": pa.array(found_b, type=pa.binary())})

    return pairs


def _block_links(crowded: DataFrame, sets: DataFrame, keys: DataFrame, ratio: tuple[int, int], scratch: Scratch, tasks: int) -> DataFrame:
    """Links between the components of the buckets in ``crowded(key, cid, comp, n)``, without a row for every pair.

    Users outside a bucket's largest component are dealt into blocks and all its users into slabs; a task compares
    a slab with a block.
    """
    parts = crowded.groupBy("key", "comp").agg(F.count("*").alias("users"), F.sum("n").alias("n"))
    whole = parts.groupBy("key").agg(F.max(F.struct("users", "comp")).alias("main"), *(F.sum(x).alias(x) for x in ("users", "n")), F.max(F.struct("users", "comp", "n")).alias("most"))
    share = lambda users, n, size: F.greatest(F.lit(1), F.ceil(users / size), F.ceil(n / SHINGLES))
    split = whole.select("key", F.col("main.comp").alias("main"), share(F.col("users"), F.col("n"), SLAB).alias("slabs"), share(F.col("users") - F.col("main.users"), F.col("n") - F.col("most.n"), BLOCK).alias("blocks"))
    placed = crowded.join(split, "key").withColumn("comp_is_main", F.col("comp") == F.col("main")).drop("main", "n", "members", "weight")
    rows = placed.join(keys, "cid").withColumn("band", F.array_position("keys", F.col("key")).cast("int") - 1).join(sets, "cid")
    rows = scratch.save(rows, "crowded-buckets", tasks)
    users = rows.withColumn("slab", F.pmod(F.xxhash64("cid"), "slabs")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    outside = rows.where("NOT comp_is_main").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
    by = ("key", "slab", "block")
    return users.groupBy(*by).cogroup(outside.groupBy(*by)).applyInArrow(_close(*ratio), "a binary, b binary")


def _meeting(placed: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs of different components that share a key and whose sizes leave the threshold possible."""
    num, den = ratio
    fits = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    left, right = (placed.select("key", F.col("cid").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return left.join(right, "key").where((F.col("comp_a") < F.col("comp_b")) & fits).select("a", "b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _centres(placed: DataFrame) -> DataFrame:
    """The most central member of each bucket and its component."""
    return placed.groupBy("key").agg(F.max(F.struct("weight", "cid", "comp")).alias("c")).select("key", F.col("c.cid").alias("centre"), F.col("c.comp").alias("centre_comp"))


def _to_centre(placed: DataFrame) -> DataFrame:
    """An edge from the centre of a bucket to each member that is in another component, once."""
    return placed.join(_centres(placed), "key").where("comp != centre_comp").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets with more than one component, each member with its own."""
    placed = shared.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", "members", "weight", F.coalesce("root", "cid").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    return placed.join(split, "key")


def link(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], ratio: tuple[int, int], scratch: Scratch) -> DataFrame:
    """``keys(cid, keys)``, an array of band keys for each cid -> ``(id, root)`` for every cid that has a link.

    ``sets_of`` turns a table of cids into ``(cid, n, sig, shingles)``, shingles being sorted
    64-bit values as bytes.  ``ratio`` is the similarity as a fraction of whole numbers.
    """
    each = keys.select(F.explode("keys").alias("key"), "cid")
    tasks = LEAST_TASKS + each.count() // KEYS_A_TASK
    sizes = each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = each.join(sizes, "key")
    central = shared.groupBy("cid").agg(F.sum("members").alias("weight"))
    shared = scratch.save(shared.join(central, "cid"), "shared-buckets", tasks)
    sets = scratch.save(sets_of(shared.select("cid").distinct()), "sets", tasks)
    star = scratch.save(_to_centre(shared.withColumn("comp", F.col("cid"))), "star", tasks)
    links = _links(star, sets, ratio, scratch, "star-links", tasks)
    roots = connected_components(links, scratch)

    rest = scratch.save(_open(shared, roots).join(sets.select("cid", "n"), "cid"), "open-buckets", tasks)
    scratch.delete(shared)
    pairs = scratch.save(_meeting(rest.where(F.col("members") <= HOT), ratio).join(_both_ways(star), ["a", "b"], "left_anti"), "pairs", tasks)
    more = _links(pairs, sets, ratio, scratch, "more-links", tasks)
    crowded = rest.where(F.col("members") > HOT)
    if crowded.limit(1).count():
        more = more.union(scratch.save(_block_links(crowded, sets, keys, ratio, scratch, tasks), "block-links", tasks))
    if more.limit(1).count():
        roots = connected_components(_as_edges(roots).union(more), scratch)
    scratch.delete(sets, star, links, rest, pairs)
    return roots
