"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakegraph.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node of each node's component, for the nodes on an edge.

    Every round first hangs each node's larger neighbours under its smallest one,
    then all nodes under the smallest of their smaller ones, until nothing moves.
    The number of rounds grows with the logarithm of the longest chain. A round is
    written to the shared folder, so plans stay flat and a lost executor costs a
    re-read. Both joins have a hub's rows on one side only, which adaptive
    execution splits. Null ends and loops are ignored.
    """
    now = edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = cut(now)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "near")
        least = cut(both.groupBy("node").agg(F.min("near").alias("other")).select("node", F.least("node", "other").alias("root")))
        # Larger neighbours go under the smallest neighbour ...
        large = both.where("near > node").join(least, "node").select(F.col("root").alias("low"), F.col("near").alias("high"))
        large = cut(large.where("low < high").distinct())
        # ... and smaller ones, with the node itself, under the smallest of them.
        smallest = cut(large.groupBy("high").agg(F.min("low").alias("root")))
        small = large.join(smallest, "high").select(F.col("root"), F.explode(F.array("low", "high")).alias("node"))
        now = cut(small.where("root < node").select(F.col("root").alias("low"), F.col("node").alias("high")).distinct())
        found = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("low", "high"), F.lit(1 << 40))), F.countDistinct("high")).first()
        if found == state or found[0] == found[2] and _flat(now):
            break
        state = found
    roots = now.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
    return roots.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _flat(edges: DataFrame) -> bool:
    """No node that stands under another has one under itself."""
    return edges.join(edges.select(F.col("high").alias("low")), "low", "left_semi").isEmpty()
