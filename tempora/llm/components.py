"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (x, y), in any direction -> (node, component), the component being its smallest node.

    Every step is a min by key and a join with it, written to the shared folder: nothing is gathered. It ends when a step
    changes no edge, and raises if that takes more than `rounds` steps (which grow with the logarithm of the nodes).
    """
    now = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    now, mark = common.stored(now, "edges"), None
    for _ in range(rounds):
        old = now
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy(F.col("x").alias("k")).agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, F.col("x") == F.col("k")).select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"))
        small = large.join(down, F.col("x") == F.col("k")).select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = common.stored(small.select("e.x", "e.y").where("x <> y").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y") % 1_000_003)).first()
        # number and hashes alone prove nothing, but a step that changed them need not be compared edge by edge
        if new == mark and now.exceptAll(old).isEmpty():
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle within {rounds} steps")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
