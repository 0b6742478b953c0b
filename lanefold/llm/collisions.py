"""Nearest vectors by counting collisions in single-projection sorted arrays.

Vectors are dealt into blocks of some ``BLOCK``, queries into chunks of some ``CHUNK``; each pair of
block and chunk is one bounded task, so that a query set of any size meets rows of any number. Within
a block each of ``PROJECTIONS`` random directions has its own sorted array. A query's window is
centred on its own projection and widened by the factor ``GROWTH`` each round (virtual rehashing:
no array is built again). What lies in the first window is counted by stretches of ``STRETCH`` entries, whose vectors are kept as bits, and
entry by entry at its ends. The ends then move on from where they were, and only the entries they pass are
counted, so that no entry is counted twice. A vector collides in a direction once the window has come to it; those with at least ``COLLISIONS`` of the directions are verified by their exact inner
product, until a ``VERIFIED`` share of the block has been. Inner products are turned
into distances by one more coordinate that brings all vectors to the largest norm of the block.

The best of each block are merged by query. On vectors without any structure, distances differ so
little that a good third of each block has to be verified for a recall above 0.9; nearer
neighbours need less. Whatever is returned is scored exactly.

Null vectors, zero vectors and those with a null, infinite or NaN component take no part, nor do rows
without id or with another number of components than most. Of rows with one id the least
vector counts. Ties go to the smaller id. With fewer than k other vectors all are returned, as the
windows grow until they hold them. An inner product beyond the range of doubles is infinite; one that
adds up both infinities counts as the smallest. No queries or no vectors give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, stored

BLOCK, CHUNK = 4096, 512
PROJECTIONS = 96
COLLISIONS = 0.6
VERIFIED = 0.4
START, GROWTH = 1.0, 1.08
STRETCH = 64
NEIGHBOURS = 20
SEED = 11


class SortedArrays:
    """A block of vectors with its projections, sorted direction by direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.ids, self.vectors = ids, vectors
        # Squares of very large or small components would leave the range of doubles.
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        squares = (scaled**2).sum(axis=1)
        self.radius = float(np.sqrt(squares.max()))
        self.directions = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1] + 1))
        lifted = np.column_stack([scaled, np.sqrt(np.maximum(0, self.radius**2 - squares))])
        projected = self.directions @ lifted.T
        self.order = np.argsort(projected, axis=1)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        # Which vectors come before every STRETCH-th place of each array, a bit for each vector.
        places, ranks = STRETCH * np.arange(-(-len(ids) // STRETCH) + 1), np.argsort(self.order, axis=1)
        self.marks = np.stack([np.packbits(row < places[:, None], axis=1) for row in ranks])
        self.touched = 0  # entries counted so far, in whole stretches or one by one

    def windows(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each array."""
        lo = np.array([row.searchsorted(c - half) for row, c in zip(self.sorted, centres)])
        hi = np.array([row.searchsorted(c + half, side="right") for row, c in zip(self.sorted, centres)])
        return lo, hi

    def stretches(self, lo: list[int], hi: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole stretches from ``lo`` to ``hi`` of each array: where they begin and end, and how often each vector is in them."""
        left, right = -(-np.array(lo) // STRETCH), np.array(hi) // STRETCH
        short = left > right
        every = np.arange(len(self.order))
        right = np.where(short, left, right)
        bits = self.marks[every, left] ^ self.marks[every, right]
        count = np.unpackbits(bits, axis=1, count=len(self.ids)).sum(axis=0, dtype=np.int64 if len(bits) > 255 else np.uint8)
        return np.where(short, hi, left * STRETCH), np.where(short, hi, right * STRETCH), count

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, verified: float = VERIFIED
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, inner products) of the best k that collide often enough, the query's own id left out."""
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        sizes = np.sqrt((scaled**2).sum(axis=1))
        centres = self.directions[:, :-1] @ (scaled * (self.radius / sizes)[:, None]).T
        n = len(self.ids)
        wanted = min(n, int(np.ceil(k + 1 + verified * n)))
        least, rounds = COLLISIONS * len(self.directions), []
        for at, (query_id, query) in enumerate(zip(query_ids.tolist(), queries)):
            count, found, r = np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
            while len(found) < wanted:
                if r == len(rounds):
                    rounds.append([x.T.tolist() for x in self.windows(centres, START * GROWTH**r * self.radius)])
                lo, hi = (x[at] for x in rounds[r])
                # What the ends have passed since the last round, on the left and on the right; all of it in the first.
                if r:
                    before = rounds[r - 1]
                    ends = zip(self.order, lo, before[0][at], before[1][at], hi)
                else:
                    left, right, whole = self.stretches(lo, hi)
                    count += whole
                    self.touched += int((right - left).sum())
                    ends = zip(self.order, lo, left.tolist(), right.tolist(), hi)
                passed = np.concatenate([x for row, a, b, c, d in ends for x in (row[a:b], row[c:d])])
                self.touched += len(passed)
                count += np.bincount(passed, minlength=n)
                found = np.flatnonzero(count >= least)
                r += 1
            found = found[self.ids[found] != query_id]
            with np.errstate(over="ignore", invalid="ignore"):
                near = self.vectors[found] @ query
                if len(found) > k and np.isfinite(near).all():
                    edge = np.partition(near, len(near) - k)[len(near) - k]
                    found = found[near >= edge - 1e-9 * max(1.0, float(np.abs(near).max()))]
                scores = (self.vectors[found] * query).sum(axis=1)  # the same for equal vectors, wherever they are
            scores = np.where(np.isnan(scores), -np.inf, scores)
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield query_id, self.ids[found][best], scores[best]


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): one row per id, of the vectors that take part."""
    rows = own_columns(table, vec_id=vec_id, v=embedding).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = stored(rows, "vectors")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def search(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, verified: float = VERIFIED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``is_query``.

    ``rows`` are (vec_id, v) as ``usable`` gives them.
    """
    schema = "query_id bigint, vec_id bigint, score double"
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, chunks = -(-counts["n"] // BLOCK), -(-counts["q"] // CHUNK)
    if not chunks:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    vectors = rows.select("vec_id", "v", dealt(blocks, 1).alias("block"), each(chunks).alias("chunk"))
    queries = rows.where(is_query).select("vec_id", "v", dealt(chunks, 2).alias("chunk"), each(blocks).alias("block"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            index = SortedArrays(left["vec_id"].to_numpy(), matrix(left["v"]))
            for query_id, ids, scores in index.search(right["vec_id"].to_numpy(), matrix(right["v"]), k, verified):
                out.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    hits = vectors.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(find, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(table: DataFrame, every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """Neighbours of every row whose id is divisible by ``every``, among all rows."""
    rows = usable(table)
    return search(rows, F.col("vec_id") % every == 0, k)
