"""Approximate search: vectors laid out by their nearest centroid, a few cells read per query.

``StoredCells`` keeps them in folders by cell; the join with the probed cells prunes folders while the
query runs. A cell may hold any share of the rows: tasks split it like any other input, and
where queries are too many to travel to every task, a cell meets them in bounded shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.vectors import l2_normalise
from lanefold.operators.pivots import nearest_join, search_groups
from lanefold.operators.search import (
    CELL_VALUES,
    SCORE_CELLS,
    Best,
    _arrow_schema,
    _final_top,
    _hit_schema,
    _hits,
    _vectors,
    pack,
    top_k,
)
from lanefold.operators.sizing import collect_bounded, written
from lanefold.sinks.tables import write_cells

MAX_CELLS = 65_536  # centroids that travel to every task; more are searched like documents
MAX_QUERIES = 4096  # queries that travel to every task; more meet their cells by a join


def group_means(df: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """(by, vec): unit mean vector per group, summed on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(by).agg(vector_to_array(mean).alias("_mean")).select(
        by, l2_normalise(F.col("_mean"), "double").alias(vec)
    )


def refine_centroids(df: DataFrame, centroids: DataFrame, rounds: int, vec: str = "vec") -> DataFrame:
    """Spherical k-means: assign to the nearest centroid, take means, again."""
    for _ in range(rounds):
        centroids = group_means(assign_cells(df, centroids, vec), "cell", vec)
    return centroids


def assign_cells(df: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with the id of the nearest centroid of each row in ``cell``; ties to the lower id."""
    few = collect_bounded(centroids.select("cell", vec).orderBy("cell"), MAX_CELLS)
    if few is None:
        numbered = written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        asked = numbered.select(F.col("_row").alias("qid"), F.col(vec).alias("qvec"))
        near = nearest_join(centroids.select("cell", vec), asked, 1, vec=vec, key="cell").select("qid", "cell")
        return numbered.drop("cell").join(near, F.col("_row") == F.col("qid")).drop("_row", "qid")
    shared = df.sparkSession.sparkContext.broadcast(pack(few))

    @F.arrow_udf("long")
    def nearest(vectors: pa.Array) -> pa.Array:
        query, out = shared.value, []
        docs = _vectors(vectors, query.matrix.shape[1])
        for at in range(0, len(docs), max(1, SCORE_CELLS // max(1, len(query)))):
            scores = docs[at : at + max(1, SCORE_CELLS // max(1, len(query)))] @ query.matrix.T
            out.append(query.ids[np.argmax(np.round(scores, 12), axis=1)])
        return pa.array(np.concatenate(out) if out else query.ids[:0])

    return df.withColumn("cell", nearest(F.col(vec)))


def probed_cells(centroids: DataFrame, queries: DataFrame, probes: int, vec: str = "vec") -> DataFrame:
    """(qid, cell, rank): the ``probes`` nearest cells of each query, any number of either."""
    cells = centroids.select(F.col("cell").cast("long").alias("cell"), vec)
    near = top_k(cells, queries.select("qid", "qvec"), probes, vec=vec, key="cell")
    return written(near.select("qid", "cell", "rank"), "probes").where(F.col("rank") <= probes)


def probe_search(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    probes: int,
    *,
    vec: str = "vec",
    key: str = "pk",
    carry: Sequence[str] = (),
    sizes: DataFrame | None = None,
    docs_per_group: int | None = None,
) -> DataFrame:
    """Top ``k`` per query among the rows of its ``probes`` nearest cells.

    Exact when ``probes`` reaches the number of cells. Which cells are probed is a relation; the index
    is joined to it by cell, so that an index laid out in folders by cell is read in those alone.
    ``sizes`` (cell, n) spares counting the index.
    """
    if k <= 0 or probes <= 0:
        raise ValueError("k and probes must be positive")
    queries = written(queries.select(F.col("qid").cast("long"), "qvec"), "queries")
    near = probed_cells(centroids, queries, probes, vec)
    few = collect_bounded(queries, MAX_QUERIES)
    if few is None:
        if sizes is None:
            sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        width = queries.select(F.size("qvec")).first()[0]
        asked = near.join(queries, "qid").select("qid", "qvec", F.col("cell").alias("_cell"))
        found = search_groups(
            index.withColumnRenamed("cell", "_cell"), sizes.withColumnRenamed("cell", "_cell"), written(asked, "asked"), k, vec=vec, key=key, carry=carry,
            docs_per_group=docs_per_group or max(1, CELL_VALUES // max(1, width)), queries_per_group=MAX_QUERIES,
        )
        return _final_top(found, key, k)
    schema = _hit_schema(index, key, carry)
    if not few.num_rows:
        return _final_top(index.sparkSession.createDataFrame([], schema), key, k)
    query = pack(few)
    place = {int(q): i for i, q in enumerate(query.ids)}
    by_cell: dict[int, list[int]] = {}
    for r in near.select("qid", "cell").toArrow().to_pylist():  # probes times MAX_QUERIES rows at most
        by_cell.setdefault(r["cell"], []).append(place[r["qid"]])
    shared = index.sparkSession.sparkContext.broadcast((query, {c: np.array(sorted(q)) for c, q in by_cell.items()}))
    arrow = _arrow_schema(schema)
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_, queries_of = shared.value
        best = Best(k, len(pack_))
        for batch in batches:
            columns = [batch.column(n) for n in names]
            cell = np.asarray(batch.column("cell"))
            docs = _vectors(batch.column(vec), pack_.matrix.shape[1])
            for c in np.unique(cell).tolist():
                at, part = np.flatnonzero(cell == c), queries_of[c]
                payload = partial(
                    lambda columns, at, j: tuple(x[int(at[j])].as_py() for x in columns), columns, at
                )
                best.offer(part, pack_.matrix[part] @ docs[at].T, payload)
        yield _hits(best, pack_, names, arrow)

    wanted = near.select(F.col("cell").cast(index.schema["cell"].dataType).alias("cell")).distinct()
    pruned = index.select(*names, vec, "cell").join(F.broadcast(wanted), "cell", "left_semi")
    return _final_top(pruned.select(*names, vec, "cell").mapInArrow(run, schema), key, k)


class StoredCells:
    """An index in a folder: vectors by batch and cell, centroids, and a manifest of what is there.

    A batch is in the manifest once all its vectors are written; what a batch that failed has
    left behind is never read. Appending touches nothing that is there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, rows: DataFrame, centroids: DataFrame, path: str, vec: str = "vec", key: str = "pk") -> StoredCells:
        centroids.select(F.col("cell").cast("long").alias("cell"), vec).write.parquet(f"{path}/centroids")
        store = cls(rows.sparkSession, path)
        store.append(rows, vec, key)
        return store

    def append(self, rows: DataFrame, vec: str = "vec", key: str = "pk") -> str:
        """Adds rows under the centroids that are there; returns the name of the batch."""
        batch = uuid.uuid4().hex
        placed = written(assign_cells(rows, self.centroids, vec), "cells")
        counts = written(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "counts")
        write_cells(placed, counts, f"{self.path}/vectors/batch={batch}", key)
        counts.select(F.lit(batch).alias("batch"), "cell", "n").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return batch

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    @property
    def rows(self) -> DataFrame:
        """The vectors of all batches in the manifest, with ``batch`` and ``cell``."""
        batches = self.manifest.select("batch").distinct()
        every = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors")
        kept = every.join(F.broadcast(batches), "batch", "left_semi")
        return kept.withColumn("cell", F.col("cell").cast("long"))

    @property
    def sizes(self) -> DataFrame:
        return self.manifest.groupBy("cell").agg(F.sum("n").alias("n"))

    def search(self, queries: DataFrame, k: int, probes: int, *, vec: str = "vec", key: str = "pk", carry: Sequence[str] = ()) -> DataFrame:
        return probe_search(self.rows, self.centroids, queries, k, probes, vec=vec, key=key, carry=carry, sizes=self.sizes)


def recall_against_exact(approximate: DataFrame, exact: DataFrame, k: int, key: str = "pk", eps: float = 1e-5) -> DataFrame:
    """Per query: recall by ids and by scores, both over ``k``.

    A hit counts by score when it reaches the exact k-th score, so that near-duplicates at
    the cut do not count as misses.
    """
    cut = exact.groupBy("qid").agg(F.min("score").alias("cut"))
    same = exact.select("qid", key, F.lit(1).alias("in_exact"))
    joined = approximate.select("qid", key, "score").join(same, ["qid", key], "left").join(cut, "qid")
    found = joined.groupBy("qid").agg(
        F.count("in_exact").alias("n_same"),
        F.count_if(F.col("score") >= F.col("cut") - eps).alias("n_good"),
    )
    return cut.join(found, "qid", "left").select(
        "qid",
        (F.coalesce("n_same", F.lit(0)) / float(k)).alias("recall_set"),
        (F.coalesce("n_good", F.lit(0)) / float(k)).alias("recall_score"),
    )
