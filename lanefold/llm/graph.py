"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the component's least node.

    Each round every node passes its least neighbour to its larger ones, then to its smaller
    ones. The number of edges never grows, and each round is written out, so that neither lineage
    nor a hub of many edges builds up: hubs are split by the skew join. Loops and repeated
    edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    stars = stored(edges.where("u <> v").select(*ends).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        stars = stored(_small(_large(stars)), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    found = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
    return found.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # Every edge goes from a node to a smaller one.
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.select("u", F.col("_m").alias("v"))).where("u <> v").distinct()
