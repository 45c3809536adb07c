"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b: two longs).

    Large-star and small-star steps alternate until no edge changes. A step keeps every
    component together and never makes more edges than it was given; a hub is split by
    its partners' neighbourhoods, since a node only meets its smallest neighbour, which
    a hash aggregation finds. Each round is a stored table in the shared folder.
    """
    current = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "lowest")
        # Large star: larger neighbours of a node move to its smallest neighbour.
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.distinct(), "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        moved = large.join(low, "a")
        small = moved.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
        current = stored(small.where("a != b").distinct(), "small-star")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
