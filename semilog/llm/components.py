"""Connected components over edges in DataFrames, by alternating large-star and small-star steps.

Every node in the end points at the smallest node that it can reach. Rounds are written to the shared folder, so
they survive lost executors; the number of rounds grows with the logarithm of the longest chain. A star's centre
may have any number of neighbours: each step needs only their minimum, which is pre-aggregated before the shuffle,
and joins it back on the centre, where Spark splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semilog.llm.common import materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: neighbours above a node go to the smallest around it. Small: all at or below it do."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def smallest_reachable(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): for every node that has an edge to a smaller one in its component, the component's smallest node.

    ``edges`` has columns u and v of one ordered type; loops and repeated edges are fine.
    """
    state = materialise(edges.where("u != v").select("u", "v").distinct(), name)
    mark = None
    while True:
        state = materialise(star(star(state, True), False), name)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return state
        mark = tuple(now)
