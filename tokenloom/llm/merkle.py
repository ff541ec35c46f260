"""A Merkle manifest of a dataset: a tree over each group of rows, and one over the groups' roots.

``arity`` consecutive nodes of a level make a node of the next.  Every level is a table of numbered nodes.  A node's siblings
have computed numbers, its own with the last bit turned in a binary tree and its run's other slots otherwise; each is met
by an equijoin of the level with itself.  The rows of slot zero then emit the parents.  Paths are handed down from
the roots: a node's path is its own siblings and then its parent's path.

Nodes are numbered without a task that sees a whole group: leaves are sorted by ranges, a task each, and the numbers
of the tasks before it are added.  Levels are written to the shared folder.  A leaf's row is some 100 bytes; texts are read once and
never shuffled.  Of the corpus the driver gets the largest group's size, the number of groups and the root.

Digests are SHA-256 over the lower-case hex of the nodes below; tables hold them as 32 bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

#: Rows of a task that ``monotonically_increasing_id`` numbers, in bits.
_ROW_BITS = 33
#: Levels whose paths are joined in one plan, before they are written.
LEVELS_A_PLAN = 4


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """The 32 bytes of the SHA-256 of the parts' concatenation."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, in the order given."""
    return digest(*[field(f) for f in fields])


def numbered(scratch: Scratch, rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place from 0 in its group of equal ``by``, ``n``, the group's size, and ``g``, the group's place among the groups.

    Both ascend, nulls first, strings bytewise.  Rows equal in ``by`` and ``order`` stand in any order.
    """
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    # the row's own number parts rows that are equal in everything else, so that no range is larger than the others
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")
    at = F.monotonically_increasing_id()
    placed = scratch.save(dealt.select(*rows.columns, F.shiftright(at, _ROW_BITS).alias("_task"), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at")), "sorted")
    # a row for each task and each group in it: no more than tasks and groups together
    counted = placed.groupBy("_task", *by).agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shift = F.sum("_rows").over(group.orderBy("_task")) - F.col("_rows") - F.col("_from")
    own = [F.col(c).alias(f"_by_{c}") for c in by]
    parts = scratch.save(counted.select(F.col("_task").alias("_t"), *own, shift.alias("_shift"), F.sum("_rows").over(group).alias("n")), "parts")
    if by:
        names = [f"_by_{c}" for c in by]
        groups = numbered(scratch, parts.select(*names).distinct(), [], names).select(*[F.col(c).alias(f"_of{c}") for c in names], F.col("i").alias("g"))
        parts = parts.join(groups, reduce(Column.__and__, [parts[c].eqNullSafe(groups[f"_of{c}"]) for c in names])).select(*parts.columns, "g")
    else:
        parts = parts.withColumn("g", F.lit(0).cast("long"))
    same = reduce(Column.__and__, [placed[c].eqNullSafe(parts[f"_by_{c}"]) for c in by], placed["_task"] == parts["_t"])
    return placed.join(parts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n", "g")


def siblings(i: Column, arity: int) -> list[Column]:
    """The numbers of the other nodes of ``i``'s run: ascending on its right, then ascending on its left."""
    if arity == 2:
        return [i.bitwiseXOR(F.lit(1).cast("long"))]
    slot = i % arity
    return [i - slot + (slot + o) % arity for o in range(1, arity)]


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(g, i, d, ...)`` with ``l`` and ``r``, the digests of the siblings on either side end to end."""
    met, left, right = nodes, [], []
    for k, number in enumerate(siblings(F.col("i"), arity)):
        other = nodes.select(F.col("g").alias(f"_g{k}"), F.col("i").alias(f"_i{k}"), F.col("d").alias(f"_d{k}"))
        met = met.withColumn(f"_s{k}", number).join(other, (F.col("g") == F.col(f"_g{k}")) & (F.col(f"_s{k}") == F.col(f"_i{k}")), "left")
        found = F.coalesce(f"_d{k}", F.lit(b""))
        left.append(F.when(F.col(f"_s{k}") < F.col("i"), found).otherwise(F.lit(b"")))
        right.append(F.when(F.col(f"_s{k}") > F.col("i"), found).otherwise(F.lit(b"")))
    return met.select(*nodes.columns, F.concat(*left).alias("l"), F.concat(*right).alias("r"))


def levels(scratch: Scratch, nodes: DataFrame, largest: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees that have siblings, leaves first, and ``(g, d)``, the groups' roots.

    ``nodes(g, i, n, d, ...)`` are leaves; other columns stay with them.  A group of one node is its own root.
    """
    found, roots = [], nodes.where("n = 1").select("g", "d")
    while largest > 1:
        level = scratch.save(with_siblings(nodes.where("n > 1"), arity), "level")
        found.append(level)
        nodes = level.where(F.col("i") % arity == 0).select("g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest(hexed(F.col("d")), hexed(F.col("r"))).alias("d"))
        roots = roots.union(nodes.where("n = 1").select("g", "d"))
        largest = -(-largest // arity)
    return found, roots


def paths(scratch: Scratch, found: list[DataFrame], above: DataFrame, arity: int) -> DataFrame | None:
    """The first of ``levels`` with ``path``, an array of (l, r) for each level up to the last root, and ``subroot``.

    ``above(g, subroot, path)`` has what follows on each group's root.
    """
    below = None
    for k in range(len(found) - 1, -1, -1):
        own = F.array(F.struct("l", "r"))
        level = found[k] if k == 0 else found[k].select("g", "i", "n", "l", "r")
        kept = [c for c in level.columns if c not in ("l", "r")]
        # the last level of a group has a run at most, so that a group meets what is above it in a few rows
        path = level.where(F.col("n") <= arity).join(above, "g").select(*kept, F.concat(own, "path").alias("path"), "subroot")
        if below is not None:
            parent = below.select(F.col("g").alias("_g"), F.col("i").alias("_p"), "path", "subroot")
            met = level.where(F.col("n") > arity).join(parent, (F.col("g") == F.col("_g")) & (F.expr(f"i div {arity}") == F.col("_p")))
            path = path.union(met.select(*kept, F.concat(own, "path").alias("path"), "subroot"))
        below = scratch.save(path, "paths") if k and k % LEVELS_A_PLAN == 0 else path
    return below


def manifest(leaves: DataFrame, group: str, order: list[str], arity: int = 3) -> DataFrame:
    """``leaves`` with ``subroot`` of its group, ``root`` of the whole (bytes) and ``path``, its siblings on the way to the root.

    ``leaves`` has a column ``leaf`` of digests.  In each group leaves ascend by ``order``, then by ``leaf``; groups ascend; nulls come
    first and are values like others.  Repeated rows are leaves each.  A group of one leaf has it as subroot; one group's subroot
    is the root.  An empty table gives no rows.  Columns called ``subroot``, ``root`` or ``path`` are replaced, all others come through.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    carried = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    sortable = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]
    rows = leaves.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(group).alias("_group"), *sortable, F.col("leaf").alias("d"))
    nodes = numbered(scratch, rows, ["_group"], [*[f"_o{k}" for k in range(len(order))], "d"]).select("row", "g", "i", "n", "d")
    nodes = scratch.save(nodes, "leaves")
    sizes = nodes.agg(F.max("n").alias("largest"), F.max("g").alias("last")).first()
    found, roots = levels(scratch, nodes, sizes["largest"] or 0, arity)
    groups = (sizes["last"] + 1) if sizes["last"] is not None else 0
    top = scratch.save(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(groups).cast("long").alias("n"), "d"), "subroots")
    upper, root = levels(scratch, top, groups, arity)
    none = F.array().cast("array<struct<l:binary,r:binary>>")
    last = root.select("g", F.col("d").alias("subroot"), none.alias("path"))
    ends = top.where("n = 1").select("i", F.col("d").alias("own"), none.alias("path"))
    above = paths(scratch, upper, last, arity)
    if above is not None:
        ends = ends.union(above.select("i", F.col("d").alias("own"), "path"))
    above = scratch.save(ends.select(F.col("i").alias("g"), F.col("own").alias("subroot"), "path"), "above")
    whole = root.first()
    out = nodes.where("n = 1").join(above, "g").select("row", "subroot", "path")
    met = paths(scratch, found, above, arity)
    if met is not None:
        out = out.union(met.select("row", "subroot", "path"))
    return out.select(*[F.col("row")[c].alias(c) for c in carried], "subroot", F.lit(bytes(whole["d"]) if whole else None).cast("binary").alias("root"), "path")


def proof(path: Column) -> Column:
    """The hex of all siblings on ``path``, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(hexed(p["l"]), hexed(p["r"]))), "")


def folded(own: Column, path: Column) -> Column:
    """The root, in hex, that ``own`` (hex) makes with the siblings on ``path``."""
    return F.aggregate(path, own, lambda a, p: F.sha2(F.concat(hexed(p["l"]), a, hexed(p["r"])), 256))
