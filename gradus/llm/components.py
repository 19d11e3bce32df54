"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.session import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that links reach, for every linked node but these smallest themselves.

    Alternates large-star and small-star steps: links to a node's neighbours
    become links to its smallest neighbour, until every component is a star.
    The number of rounds grows with the logarithm of a component's size. It
    ends when a round leaves the links as they were, which is counted row by row.
    """
    flat = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    if flat.isEmpty():
        return flat.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u > v").unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        # a star has one link from each node and none from a centre
        ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select("v", F.lit(0), F.lit(1)).toDF("u", "out", "into"))
        loose = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 OR (out > 0 AND into > 0)")
        flat = now
        if loose.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component"))
