"""Connected components of a graph given by its edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import settled


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``edges`` (``a``, ``b``: two longs).

    Each round lets every node point to its smallest neighbour, follows the pointers (in doubling steps) to nodes that
    have no smaller neighbour, and contracts the edges to these; only edges between different ones remain for the next
    round, and no two of them were neighbours, so that at least half of the nodes go in each round. The largest neighbourhood is reduced
    to its minimum before it is shuffled, so that a hub needs no list of its neighbours in one place.
    """
    edges = settled(edges.select("a", "b").where("a != b").distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("label"))
        moved = True
        while moved:
            for _ in range(2):
                onward = points.select(F.col("node").alias("label"), F.col("label").alias("next"))
                points = points.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
            # a second step that moved nothing has found the ends; what it found is looked at, not computed again
            points = settled(points)
            moved = not points.where("moved").isEmpty()
            points = points.select("node", "label")
        steps.append(points)
        left = points.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = points.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = settled(
            edges.join(left, "a").join(right, "b").where("la != lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = steps[-1]
    for points in reversed(steps[:-1]):
        onward = whole.select(F.col("node").alias("label"), F.col("label").alias("next"))
        whole = points.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return settled(whole.select("node", F.col("label").alias("component")))
