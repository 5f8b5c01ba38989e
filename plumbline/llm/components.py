"""Connected components of a graph that may have hubs, by alternating stars.

The large-star and small-star rounds of Kiveris et al. (Connected Components in MapReduce and
Beyond) never hold more edges than they began with. Each round's edges go to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_side

#: A table of minima of at most so many rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Edges to a partition: a small graph is not strewn over as many files a round as a large one.
EDGES = 100_000


def _minima(edges: DataFrame, parts: int) -> DataFrame:
    """Per node its least neighbour or itself. Checkpointed, so that adaptive execution sees two plain sides."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    return small_side(cut_lineage(least), BROADCAST_ROWS)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges``: the root is the least node that can be reached.

    Ends of edges are bigints. Loops, repeated edges and edges with a null end add nothing.
    """
    now = cut_lineage(
        edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before, parts = state, max(1, -(-state[0] // EDGES))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.where("v > u")
            .join(_minima(both, parts), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        large = cut_lineage(large.coalesce(parts))
        now = cut_lineage(
            large.join(_minima(large, parts), "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
            .coalesce(parts)
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
