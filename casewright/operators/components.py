"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.plans.session import cut


def connected_components(edges: DataFrame, a: str, b: str, node: str = "node", root: str = "root", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``root``.

    Alternates large-star and small-star steps, which halve path lengths, until nothing changes; each round is two
    shuffles of at most as many edges as there were, checkpointed in the shared folder. Edges with a null end and
    loops are ignored, repeated edges count once, an empty input gives an empty result. Nodes without an edge are
    not returned. Raises RuntimeError if ``max_rounds`` is reached (logarithmic rounds are expected).

    A star step never gathers a neighbourhood into one row: the minimum of a node's neighbours is an aggregate
    (combined before the shuffle) that is joined back, so a node with a third of all edges stays splittable.
    Both sides of these joins grow with the edges, so neither is broadcast.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v").distinct()
        down = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(down.hint("merge"), "u")
        e = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias(node), F.col("v").alias(root)).union(
                e.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
