"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.llm import store


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node of the component.

    Every round each node takes the smallest root among its neighbours, for itself and for the root it had, and then follows its
    root's root. Roots only fall, so the round in which nothing falls is the last. Every round is a written table; only the number
    of edges comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = store.written(both, "edges")
    size = both.count()
    roots = store.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots", size)
    for _ in range(rounds):
        near = both.join(roots, both.b == roots.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        seen = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooked = seen.select("node", F.col("low").alias("root")).unionByName(seen.select(F.col("root").alias("node"), F.col("low").alias("root")))
        hooked = store.written(hooked.groupBy("node").agg(F.min("root").alias("root")), "roots", size)
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        after = store.written(hooked.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "roots", size)
        changed = not after.join(roots, ["node", "root"], "left_anti").isEmpty()
        roots = after
        if not changed:
            return roots
    raise RuntimeError("components did not settle")
