"""Connected components of a graph of any size: alternating large and small stars, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node other than that smallest one of edges (a, b).

    Every round hangs the neighbours of a node on the smallest of them; rounds grow as the logarithm of the longest path.
    Nothing reaches the driver but counts. Self-links and nulls are ignored; without edges the result is empty.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), slim=True)
    was = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), slim=True)
        large = cut(join_groups(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), slim=True)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), slim=True)
        hung = join_groups(large, least, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), slim=True)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if state == was or state[0] == state[2] and not now.join(now.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = state
