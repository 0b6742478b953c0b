"""Centroid clustering with geometric drift tightening.

Every vector keeps the cluster it was assigned to and one lower bound on its distance to all
other centroids. When centroids move, that bound is loosened by how much nearer any other centroid can
have come to a point of the cluster's sphere (centre: the cluster's centroid before the move,
radius: its farthest member). In the plane of centre, old and new centroid this is
drift * cos(angle) at most, the angle being that between the move and the sphere's nearest edge as
seen from half way, which is less than the full drift wherever the sphere lies aside, and an
increase where it lies behind. A vector whose exact distance to its own centroid stays below the bound keeps its cluster;
the others are ambiguous and are scanned exactly against all centroids.

A round is one pass: it reads the last state, writes the next one and, beside it, sums per task
and cluster, of which k rows reach the driver. States are files in the shared folder; one that has been
superseded is removed. Nothing is shuffled but the sums, so a vector that a third of all
rows repeat does no harm. Sums and distances are integers, so any split of the rows gives the same centroids.

Vectors with another number of components, a null or non-finite one, or one of 131,072 or more
(whose squared distances leave 64 bits) take no part. Rows without id are clustered like others
but start no centroid unless rows with an id are too few. Repeated rows are separate
vectors. With fewer vectors than k, each starts a centroid; without any, there are no rows.
Ties go to the smaller number. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanefold.llm.common import own_columns, releasing
from lanefold.session import scratch_path

DIMENSIONS = 64
CLUSTERS, ROUNDS = 8, 10
SCALE = 1024
LARGEST = 1 << 17
SALT = "3:"

ROWS, SUMS = "rows", "sums"


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """A bound on how much nearer ``new`` is than ``old`` to any point of a sphere; negative where all are farther."""
    move = new - old
    drift = float(np.linalg.norm(move))
    if drift == 0:
        return 0.0

    def widest(seen_from: np.ndarray) -> float:
        to = centre - seen_from
        far = float(np.linalg.norm(to))
        if far <= radius:
            return 1.0
        angle = np.arccos(np.clip(to @ move / (far * drift), -1, 1)) - np.arcsin(radius / far)
        return float(np.cos(max(0.0, angle)))

    # |x - old| - |x - new| = drift * (distance of x beyond the middle plane) / (half the sum of both
    # distances), and half the sum is at least the distance to the middle.
    ahead = drift * widest((old + new) / 2)
    if ahead >= 0:
        return ahead
    # All points are behind the middle plane. Seen from a point moving from old to new, the angle
    # to the move only grows, so that the first one bounds the mean of its cosine.
    return min(0.0, drift * widest(old))


@dataclass
class Bounds:
    """What a round needs besides the state: small arrays, k by d at most."""

    centroids: np.ndarray
    loosened: np.ndarray | None = None
    apart: np.ndarray = field(init=False)
    slack: float = field(init=False)

    def __post_init__(self) -> None:
        c = self.centroids.astype(np.float64)
        gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gaps, np.inf)
        self.apart = gaps.min(axis=1)
        # Far above what rounding does to a bound in any number of rounds worth running.
        self.slack = 1e-6 * (1 + float(np.abs(c).max(initial=0)))


def bounds(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Bounds:
    """Bounds for the round after centroids moved from ``old`` to ``new``; ``radius`` -1 for an empty cluster."""
    k = len(old)
    a, b = old.astype(np.float64), new.astype(np.float64)
    most = np.full(k, -np.inf)
    for i in range(k):
        for j in range(k):
            if i != j and radius[i] >= 0:
                most[i] = max(most[i], loosening(a[i], float(radius[i]), a[j], b[j]))
    return Bounds(new, np.where(np.isfinite(most), most, 0.0))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, each vector to its row of ``centroids`` or all to one."""
    gap = vectors - centroids
    return np.einsum("ij,ij->i", gap, gap)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties), its squared distance, and the distance to the next."""
    each = np.stack([squared(vectors, c) for c in centroids], axis=1)
    cluster = each.argmin(axis=1)
    nearest = each[np.arange(len(each)), cluster]
    if len(centroids) == 1:
        return cluster, nearest, np.full(len(each), np.inf)
    return cluster, nearest, np.sqrt(np.partition(each, 1, axis=1)[:, 1].astype(np.float64))


def reassign(
    vectors: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, now: Bounds
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, squared distance and lower bound under the new centroids, and how many were scanned."""
    if cluster is None:
        return *scan(vectors, now.centroids), len(vectors)
    own = squared(vectors, now.centroids[cluster])
    near = np.sqrt(own.astype(np.float64))
    lower = np.maximum(lower - now.loosened[cluster], now.apart[cluster] - near)
    unsure = np.flatnonzero(near + now.slack + 1e-6 * near >= lower)
    cluster = cluster.copy()
    if len(unsure):
        cluster[unsure], own[unsure], lower[unsure] = scan(vectors[unsure], now.centroids)
    return cluster, own, lower, len(unsure)


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers floor(1024 * x)."""
    rows = own_columns(vectors, vec_id="vec_id", embedding="embedding")
    real = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)
    fit = rows.select("vec_id", real.alias("_x")).where((F.size("_x") == dimensions) & ~F.exists("_x", bad))
    return fit.select("vec_id", F.transform("_x", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors whose salted ids have the least digests, in that order."""
    digest = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([s["v"] for s in seeds], dtype=np.int64)


def _write_round(rows: DataFrame, now: Bounds) -> str:
    """The next state of ``rows`` and its sums, below a new path."""
    first = now.loosened is None
    kind = rows.schema["vec_id"].dataType.simpleString()
    d = now.centroids.shape[1]
    schema = f"part string, vec_id {kind}, v array<int>, cluster int, lower double, distance bigint, totals array<bigint>"

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        n, total, far = (np.zeros(k, np.int64) for _ in range(3))
        sums, scanned = np.zeros((k, d), np.int64), 0
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            before = (None, None) if first else (batch.column("cluster").to_numpy(), batch.column("lower").to_numpy())
            cluster, distance, lower, looked_at = reassign(v, *before, now)
            scanned += looked_at
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
            np.add.at(total, cluster, distance)
            np.maximum.at(far, cluster, distance)
            m = len(v)
            yield pa.record_batch(
                [
                    pa.array([ROWS] * m, pa.string()), batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)),
                    pa.array(lower), pa.array(distance), pa.nulls(m, pa.list_(pa.int64())),
                ],
                names=NAMES,
            )
        first_only = np.where(np.arange(k) == 0, scanned, 0)
        totals = np.column_stack([far, n, total, first_only, sums])
        yield pa.record_batch(
            [
                pa.array([SUMS] * k), pa.nulls(k, id_type), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)),
                pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), pa.array(list(totals)),
            ],
            names=NAMES,
        )

    id_type = to_arrow_type(rows.schema["vec_id"].dataType)
    path = scratch_path(rows.sparkSession, "clusters")
    rows.mapInArrow(work, schema).write.partitionBy("part").parquet(path)
    return path


NAMES = ["part", "vec_id", "v", "cluster", "lower", "distance", "totals"]


def _totals(spark: SparkSession, path: str, k: int, d: int) -> tuple[np.ndarray, list[list[int]]]:
    """Per cluster its farthest squared distance, and size, summed distance, scanned vectors and summed components."""
    sums = spark.read.schema("cluster int, totals array<bigint>").parquet(f"{path}/part={SUMS}")
    each = sums.select("cluster", F.posexplode("totals").alias("i", "t")).groupBy("cluster", "i")
    far, totals = np.zeros(k), [[0] * (3 + d) for _ in range(k)]
    for r in each.agg(F.max("t").alias("most"), F.sum(F.when(F.col("i") > 0, F.col("t"))).alias("total")).collect():
        if r["i"]:
            totals[r["cluster"]][r["i"] - 1] = r["total"]
        else:
            far[r["cluster"]] = r["most"]
    return far, totals


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class Clusters:
    """``rows`` (vec_id, v, cluster, distance) and, per cluster, its centroid, size and summed distance."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: list[int]
    inertia: list[int]
    scanned: list[int]


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> Clusters | None:
    """The vectors after ``rounds`` rounds and one more assignment; None without vectors.

    ``scanned`` tells of each assignment how many vectors were compared with all centroids.
    """
    spark = vectors.sparkSession
    start = scratch_path(spark, "vectors")
    whole_vectors(vectors, dimensions).write.parquet(start)
    kept = spark.read.schema(whole_vectors(vectors, dimensions).schema).parquet(start)
    now = first_centroids(kept, k)
    if not len(now):
        return None
    kind = kept.schema["vec_id"].dataType.simpleString()
    rows, path, step, scanned = kept, start, Bounds(now), []
    for left in range(rounds, -1, -1):
        written = _write_round(rows, step)
        rows = spark.read.schema(f"vec_id {kind}, v array<int>, cluster int, lower double, distance bigint").parquet(f"{written}/part={ROWS}")
        farthest, totals = _totals(spark, written, len(step.centroids), dimensions)
        _remove(spark, path)
        path, old = written, step.centroids
        scanned.append(sum(t[2] for t in totals))
        new = np.array([[s // t[0] for s in t[3:]] if t[0] else c for t, c in zip(totals, old.tolist())], dtype=np.int64)
        if not left or (new == old).all():
            # Centroids that stay leave every assignment as it is.
            break
        step = bounds(old, new, np.where([t[0] > 0 for t in totals], np.sqrt(farthest), -1.0))
    return Clusters(rows, old, [t[0] for t in totals], [t[1] for t in totals], scanned)


RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    found = clusters(vectors, k, rounds)
    if found is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, {RESULT}")
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    of = [(i, found.inertia[i], sum(found.inertia), sha[i]) for i in range(len(sha))]
    each = spark.createDataFrame(of, "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.rows.join(F.broadcast(each), F.col("cluster") == F.col("_cluster"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustered_sql(k: int = CLUSTERS, rounds: int = ROUNDS, d: int = DIMENSIONS) -> str:
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST})) = 0),
cells AS MATERIALIZED (SELECT r, i, v[i] AS x FROM kept, range(1, {d + 1}) AS t(i)),
c0 AS MATERIALIZED (
  SELECT k, i, v[i] AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept QUALIFY k < {k}),
    range(1, {d + 1}) AS t(i))"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (
  SELECT r, k, distance FROM (
    SELECT r, k, sum((cells.x - c.x) * (cells.x - c.x)) AS distance FROM cells JOIN c{t} AS c USING (i) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{t} AS c LEFT JOIN (
    SELECT k, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x
    FROM cells JOIN a{t} USING (r) GROUP BY k, i) AS m USING (k, i))"""
            )
    last = rounds
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (r)
JOIN (SELECT k, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k) USING (k)"""
    )


CLUSTERED_SQL = _clustered_sql()
