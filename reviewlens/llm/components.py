"""Connected components of an edge table, by alternating large and small stars.

Each round hooks the neighbours of a node to the least of them.  Minima are aggregated before they are
shuffled and joined back, so a hub with a third of all edges is neither one group nor one task.  Rounds
grow with the logarithm of the longest path.  Edges stay in written tables and never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of each node that has an edge to another.

    ``edges`` has long columns a and b; edges from a node to itself and repeated edges do not matter.
    """
    pairs = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least).distinct())
        pairs = materialise(small)
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
