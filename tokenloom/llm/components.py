"""Connected components of an edge table by minimum label and pointer jumping, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

#: A round's table is written by so many tasks and one more for each so many edges.
LEAST_TASKS, ROWS_A_TASK = 6, 500_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)``, either direction, any orderable id type -> ``(id, root)``, root the least id reachable.

    Each round gives every node the least label among itself and its neighbours, then
    replaces labels by their labels' labels, so that a path of length d takes about
    log d rounds.  Labels are aggregated before they are shuffled, so a hub with any
    number of neighbours is one partial minimum per task.  Every round is written to the
    shared folder.  Nulls, self-loops and repeated edges change nothing; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    both = scratch.save(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    tasks = LEAST_TASKS + both.count() // ROWS_A_TASK
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", tasks)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = low.join(up, "root", "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = scratch.save(step, "labels", tasks)
        changed = new.where("root != was").limit(1).count()
        scratch.delete(labels)
        labels = new
        if not changed:
            scratch.delete(both)
            return labels.select("id", "root")
