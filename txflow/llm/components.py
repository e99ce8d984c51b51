"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txflow.session import cut


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each neighbour of u is linked to the least of u and its neighbours.

    ``larger_only`` links the neighbours above u (every edge is seen from both ends), otherwise
    those below u (every edge is seen from its larger end) and u itself.
    """
    if larger_only:
        seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # A node with very many neighbours is split by AQE: the minimum is a table of its own, not a window.
    both = seen.join(least, F.col("u") == F.col("w"))
    moved = both.filter(F.col("v") > F.col("u")) if larger_only else both
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of its component.

    Alternates two contractions until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. Each round is written, so lineage stays short.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        edges = cut(_towards_least(_towards_least(edges, True), False))
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        state = new
    raise RuntimeError(f"no fixed point after {rounds} rounds")
