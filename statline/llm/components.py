"""Connected components of a graph of any size, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its least neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these. Edges lead down."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any direction to (u, v) with v the least node of u's component.

    Least nodes themselves and nodes without edges have no row. Rounds of large and
    small stars end when a round changes nothing; each is stored in the checkpoint
    folder. All sums combine before their shuffle, and a node with very many edges
    only ever meets one row in a join, which adaptive execution splits. Edges with a
    null end, loops and repeated edges have no effect.
    """
    edges = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = checkpointed(edges.distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges
        seen = now
        edges = checkpointed(_small_star(_large_star(edges)))
