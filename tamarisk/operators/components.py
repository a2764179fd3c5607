"""Connected components of an edge list, by alternating star contractions.

Large-star/small-star (Kiveris et al., "Connected components in MapReduce and
beyond", SoCC 2014): every step is an aggregate with map-side combine and one
equi-join, and no task ever holds the neighbours of a node. A hub only makes
its join key heavy, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.materialise import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Edges are undirected; null ends, self-loops and repeats are ignored (a node
    with nothing but self-loops does not come out). An empty input gives an
    empty result. Nodes may be of any orderable type. Raises if the contraction
    has not settled after ``max_rounds`` (it needs about log2 of the diameter).
    """
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src) != F.col(dst)).alias("_ok"))
        .where(F.col("_ok"))
        .select("u", "v")
        .distinct()
    )
    now = cut(now)
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("h"),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
