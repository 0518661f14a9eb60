"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, remove, stored


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Each round re-hangs neighbours onto the smallest node of a neighbourhood, which needs
    grouped minima and one join on the node, never a list of all neighbours. Rounds are
    checkpointed. The minima are written and read again before they are joined: both sides of
    the join are then shuffled for it alone, and adaptive execution can split the key of a
    hub. Null ends and self-links are ignored; no links give no rows. If the rounds run out,
    RuntimeError is raised rather than a wrong result returned.
    """
    ends = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = checkpoint(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark = links.sparkSession
    for _ in range(rounds):
        # large star: larger neighbours move to the smallest of the neighbourhood, the node itself included
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, first = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, second = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the node and its smaller neighbours move to the smallest of them
        low, third = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = checkpoint(small.where("u <> v").distinct())
        # done when every node hangs on one root and no root hangs on another node
        roots = after.select(F.col("v").alias("u")).distinct()
        open_ = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(after.join(roots, "u", "left_semi").select("u"))
        edges = after
        for path in (first, second, third):
            remove(spark, path)
        if not open_.take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
