"""Connected components by contraction, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) of every node that has a link.

    Each round every node takes its smallest neighbour, chains are followed to their ends by doubling, and links are
    rewritten between the ends. At least half of the nodes that still have links go away in a round, so rounds grow
    with the logarithm of the nodes. The minimum is a partial aggregation, so a hub costs one row per task.
    Links to itself and nulls are left out; repeated links do no harm; no links give no rows.
    """
    left = written(links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")), "links")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        while True:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above")).where("root != above")
            nxt = written(up.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
            moved = not nxt.where("moved").isEmpty()
            up = nxt.drop("moved")
            if not moved:
                break
        ends = lambda name: up.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: E731, B023
        left = written(
            left.join(ends("a"), "a").join(ends("b"), "b").where("a_root != b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if roots is None:
            roots = up
        else:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = written(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
