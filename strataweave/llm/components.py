"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge; ``component`` is the smallest reachable id.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): every step links nodes to the smallest neighbour, so that a path of n nodes ends
    after O(log^2 n) rounds. A round is two aggregations and two joins on node ids; what comes to
    the driver is one row of sums a round. Each round is written to the shared folder. Null ends and
    self-links are ignored; an empty table gives an empty result.
    """
    links = edges.select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    ).filter("u is not null and v is not null and u <> v")
    links = materialize(links.distinct(), "cc-links")
    state = _state(links)
    while True:  # every step moves links to smaller ids, until none can move
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # The smallest neighbour takes over the others, and the node itself stays linked to it.
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        before, links = state, materialize(small, "cc-links")
        state = _state(links)
        if state == before:  # stars stay as they are
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    """Number and summed hashes of the links: equal, but for a collision of 64-bit sums, only for equal tables."""
    x, y = (F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(20,0)")) for i in range(2))
    return tuple(links.agg(F.count("*"), x, y).first())
