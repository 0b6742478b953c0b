"""Combining ranked lists of several lanes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_lane(hits: DataFrame, lane: str) -> DataFrame:
    return hits.withColumn("lane", F.lit(lane))


def union_lanes(per_lane: Mapping[str, DataFrame]) -> DataFrame:
    """Hits of all lanes as one relation with a ``lane`` column."""
    out = None
    for lane, hits in per_lane.items():
        tagged = tag_lane(hits, lane)
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no lanes to fuse")
    return out


def reciprocal_rank_fusion(hits: DataFrame, top_k: int, rrf_k: int = 60, key: str = "pk") -> DataFrame:
    """(qid, key, score, per_lane, rank) from hits (qid, key, lane, score, rank) of several lanes.

    Each lane adds ``1 / (rrf_k + position)``. Lanes must be cut to their own depth before.
    Equal scores are ordered by key. Terms are added in lane order, so sums are reproducible.
    """
    if min(rrf_k, top_k) < 1:
        raise ValueError(f"depth {top_k} and constant {rrf_k} have to be positive")
    fused = hits.groupBy("qid", key).agg(
        F.sort_array(F.collect_list(F.struct("lane", "score", "rank"))).alias("_lanes")
    )  # one entry per lane: bounded by the number of lanes
    fused = fused.select(
        "qid",
        key,
        F.aggregate(
            "_lanes", F.lit(0.0), lambda s, h: s + F.lit(1.0) / (F.lit(float(rrf_k)) + h["rank"])
        ).alias("score"),
        F.map_from_entries(
            F.transform("_lanes", lambda h: F.struct(h["lane"], h["score"]))
        ).alias("per_lane"),
    )
    return rerank(fused, key).where(F.col("rank") <= top_k)


def single_lane(hits: DataFrame, lane: str, key: str = "pk") -> DataFrame:
    """One lane as it is, in the shape of a fused list."""
    return hits.select(
        "qid", key, "score", F.create_map(F.lit(lane), F.col("score")).alias("per_lane"), "rank"
    )


def rerank(hits: DataFrame, key: str = "pk") -> DataFrame:
    """Contiguous 1-based ranks per query, by score and then key."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def to_submissions(hits: DataFrame, key: str = "pk") -> DataFrame:
    """Ranked answers (task_id, rank, score, frame_id, text); the global key is the answer."""
    order = Window.partitionBy("qid").orderBy("rank")
    return hits.select(
        F.col("qid").cast("string").alias("task_id"),
        F.row_number().over(order).cast("long").alias("rank"),
        "score",
        F.col(key).alias("frame_id"),
        F.lit(None).cast("string").alias("text"),
    )
