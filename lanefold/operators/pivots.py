"""Exact nearest neighbours of many by many: partitions about pivots, pruned by distance bounds.

Inner products are turned into distances by one more coordinate, which brings all documents to the
largest norm; then the triangle inequality holds for them. Each document belongs to its nearest pivot.
A query first searches the partition of its own nearest pivot, which bounds its k-th best score. In
the second round it visits those partitions alone that may hold something as good: by their
least and largest distance to their pivot, and by the plane half way between both pivots.

What meets is one bundle of partitions, or one share of a large one, and one block of its queries at a
time, both bounded, so that neither a partition nor a query set of any size ends in one task. A query is sent
once to each bundle it visits, however many of its partitions those are, and with its k-th best score, so that only
better documents come back: where nothing can be pruned, vectors are sent ``BUNDLES`` and ``BLOCKS`` times, not
once per partition, as long as the bounds on a group allow. Equal vectors are searched
once: of one vector's documents only the first k keys can be among the best, and equal queries
have equal answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanefold.functions.vectors import dot
from lanefold.operators import search as S
from lanefold.operators.sizing import written

PIVOTS = 1_024
QUERIES_PER_GROUP = 65_536
BUNDLES = 16
ROWS_PER_BUNDLE = 1_024  # at least, if there are fewer than BUNDLES
BLOCKS = 8
QUERIES_PER_BLOCK = 4_096  # at least, if there are fewer than BLOCKS
GROUP_VALUES = S.CELL_VALUES
COPY_SHARES = 64
SLACK = 1e-9


def search_groups(
    rows: DataFrame,
    sizes: DataFrame,
    probes: DataFrame,
    k: int,
    *,
    vec: str,
    key: str,
    carry: Sequence[str] = (),
    docs_per_group: int,
    queries_per_group: int = QUERIES_PER_GROUP,
) -> DataFrame:
    """(qid, key, carried, score): the best ``k`` per query and group of the cells it probes.

    ``rows`` and ``probes`` (qid, qvec, _cell) meet by ``_cell``, a share of the one with a block of the
    other; ``sizes`` (_cell, n) says how many shares a cell needs. Cells that no query probes are not
    read where ``rows`` are laid out by cell.
    """
    schema = S._hit_schema(rows, key, carry)
    arrow = S._arrow_schema(schema)
    names = [key, *carry]
    counted = probes.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    shares = F.ceil(F.col("n") / docs_per_group).cast("int").alias("_shares")
    blocks = F.ceil(F.col("_n") / queries_per_group).cast("int").alias("_blocks")
    wanted = written(counted.join(sizes, "_cell").select("_cell", shares, blocks), "wanted").where("_shares > 0")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select(*names, vec, "_cell").join(wanted, "_cell").select(
        *names, F.col(vec).alias("_vec"), "_cell", F.pmod(F.xxhash64(key), "_shares").cast("int").alias("_share"), upto("_blocks").alias("_block")
    )
    right = probes.select("qid", "qvec", "_cell").join(wanted, "_cell").select(
        "qid", "qvec", "_cell", upto("_shares").alias("_share"), F.pmod(F.xxhash64("qid"), "_blocks").cast("int").alias("_block")
    )

    def run(_: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        query = S.pack(asked.select(["qid", "qvec"]))
        best = S.Best(k, len(query))
        for batch in docs.combine_chunks().to_batches() if len(query) else []:
            cells = [batch.column(n) for n in names]
            payload = partial(lambda cells, j: tuple(c[j].as_py() for c in cells), cells)
            for part, scores in S.dense_scores(query, batch.column("_vec")):
                best.offer(part, scores, payload)
        return pa.Table.from_batches([S._hits(best, query, names, arrow)])

    by = ["_cell", "_share", "_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


class Pivots:
    """Pivots in the space of distances, and how far their partitions reach."""

    def __init__(self, matrix: np.ndarray, largest: float) -> None:
        self.largest = largest  # squared norm that all documents are brought to
        self.matrix = self.lifted(matrix)
        self.between = self._distances(self.matrix)
        self.n = np.zeros(len(matrix), np.int64)
        self.least = np.zeros(len(matrix))
        self.most = np.zeros(len(matrix))

    def lifted(self, docs: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.largest - np.einsum("ij,ij->i", docs, docs))
        return np.column_stack([docs, np.sqrt(rest)])

    def _distances(self, x: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ self.matrix.T + np.einsum("ij,ij->i", self.matrix, self.matrix)
        return np.sqrt(np.maximum(squares, 0))

    def of_docs(self, docs: np.ndarray) -> np.ndarray:
        return self._distances(self.lifted(docs))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack([queries, np.zeros(len(queries))]))

    def reach(self, far: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has ``k`` documents, by the partitions' sizes and reach alone."""
        out = np.full(len(far), np.inf)
        ends = far + self.most
        order = np.argsort(ends, axis=1)
        enough = np.cumsum(self.n[order], axis=1) >= k
        some = enough.any(axis=1)
        at = enough.argmax(axis=1)
        rows = np.flatnonzero(some)
        out[rows] = ends[rows, order[rows, at[rows]]]
        return out

    def visited(self, far: np.ndarray, home: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Which partitions, the home one aside, may hold a document within the given distance."""
        own = far[np.arange(len(far)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((far**2 - own**2) / (2 * self.between[home]), nan=0.0, posinf=0.0, neginf=0.0)
        least = np.maximum.reduce([far - self.most, self.least - far, plane, np.zeros_like(far)])
        slack = SLACK * (1 + self.largest)
        hit = (least**2 <= within[:, None] ** 2 + slack) & (self.n > 0)
        hit[np.arange(len(far)), home] = False
        return hit


def without_copies(docs: DataFrame, k: int, vec: str, key: str) -> DataFrame:
    """The documents without those whose vector has ``k`` copies of lesser keys: they can be no query's."""
    crowded = docs.groupBy(F.xxhash64(vec).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k)
    crowded = written(crowded.select("_h"), "copies")
    if crowded.isEmpty():
        return docs
    hashed = docs.withColumn("_hash", F.xxhash64(vec))
    on = F.col("_hash") == F.col("_h")
    share = F.pmod(F.xxhash64(key), F.lit(COPY_SHARES))
    many = hashed.join(crowded, on, "left_semi")
    for by in ([vec, share], [vec]):
        many = many.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_place") <= k)
    return hashed.join(crowded, on, "left_anti").unionByName(many.drop("_place")).drop("_hash")


def partitioned(docs: DataFrame, k: int, vec: str, key: str, carry: Sequence[str], n_pivots: int | None) -> tuple[DataFrame, Pivots | None]:
    """The documents with their partition as ``_cell``, and the pivots with what they reach."""
    docs = written(without_copies(docs.select(key, *carry, vec), k, vec, key), "documents")
    n, largest = docs.agg(F.count(F.lit(1)), F.max(dot(F.col(vec), F.col(vec)))).first()
    if not n:
        return docs, None
    count = n_pivots or min(PIVOTS, math.isqrt(n - 1) + 1)
    chosen = docs.orderBy(F.xxhash64(key), key).limit(count).select(F.xxhash64(key), vec).toArrow()
    pivots = Pivots(S.pack(chosen).matrix, float(largest))
    shared = docs.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*docs.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            far = at.of_docs(S._vectors(batch.column(vec), at.matrix.shape[1] - 1))
            cell = far.argmin(axis=1)
            gap = far[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], [*batch.schema.names, "_cell", "_gap"])

    placed = written(docs.mapInArrow(place, schema), "partitions")
    ends = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_gap").alias("least"), F.max("_gap").alias("most"))
    for r in ends.collect():
        pivots.n[r["_cell"]], pivots.least[r["_cell"]], pivots.most[r["_cell"]] = r["n"], r["least"], r["most"]
    return placed, pivots


class Bundles:
    """Consecutive partitions that are searched together; a large one is dealt over bundles of its own."""

    def __init__(self, sizes: np.ndarray, most: int) -> None:
        self.first = np.zeros(len(sizes), np.int64)
        self.shares = np.maximum(1, -(-sizes // most))
        self.spans: list[list[int]] = []  # of each bundle, its first cell and the one after its last
        held = 0
        for cell, n in enumerate(sizes.tolist()):
            if not self.spans or held + n > most:
                self.spans += [[cell, cell] for _ in range(self.shares[cell])]
                held = 0
            self.first[cell] = len(self.spans) - self.shares[cell]
            for span in self.spans[self.first[cell] :]:
                span[1] = cell + 1
            held = held + n if self.shares[cell] == 1 else most


def _home_probes(asked: DataFrame, pivots: Pivots) -> DataFrame:
    """(qid, qvec, _cell): the partition of each query's nearest pivot."""
    shared = asked.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            far = at.of_queries(S._vectors(batch.column("qvec"), at.matrix.shape[1] - 1))
            home = np.where(at.n > 0, far, np.inf).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.select(["qid", "qvec"]).columns, pa.array(home.astype(np.int32))], ["qid", "qvec", "_cell"])

    kind = asked.schema["qvec"].dataType.simpleString()
    return asked.mapInArrow(work, f"qid bigint, qvec {kind}, _cell int")


def _visits(asked: DataFrame, pivots: Pivots, bundles: Bundles, k: int) -> DataFrame:
    """(qid, qvec, cut, _bundle, _visited): where else queries with a k-th best score so far search, a bit for each partition of the bundle."""
    shared = asked.sparkSession.sparkContext.broadcast(pivots)
    spans = bundles.spans

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in (b.slice(start, 256) for b in batches for start in range(0, b.num_rows, 256)):
            q = S._vectors(batch.column("qvec"), at.matrix.shape[1] - 1)
            far = at.of_queries(q)
            home = np.where(at.n > 0, far, np.inf).argmin(axis=1)
            cut = batch.column("cut").to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q) + at.largest - 2 * cut))
            hit = at.visited(far, home, np.fmin(known, at.reach(far, k)))
            rows, bundle, bits = [], [], []
            for i, (lo, hi) in enumerate(spans):
                row = np.flatnonzero(hit[:, lo:hi].any(axis=1))
                rows.append(row)
                bundle.append(np.full(len(row), i, np.int32))
                bits += [x.tobytes() for x in np.packbits(hit[row, lo:hi], axis=1)]
            taken = batch.select(["qid", "qvec", "cut"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(bundle)), pa.array(bits, pa.binary())], ["qid", "qvec", "cut", "_bundle", "_visited"]
            )

    kind = asked.schema["qvec"].dataType.simpleString()
    return asked.mapInArrow(work, f"qid bigint, qvec {kind}, cut double, _bundle int, _visited binary")


class _Top:
    """The best ``k`` documents per query, of those not worse than a known score."""

    def __init__(self, k: int, cut: np.ndarray, rank: np.ndarray) -> None:
        self.k, self.floor, self.rank = k, cut, rank
        self.scores = np.full((len(cut), k), -np.inf)
        self.docs = np.full((len(cut), k), -1)

    def offer(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some documents (columns) for some queries (rows)."""
        bar = self.floor[queries] - 2 * 10.0**-S.SCORE_DIGITS
        width, free = scores.shape[1], np.flatnonzero(np.isneginf(bar))
        if len(free) and width > self.k:
            bar[free] = np.partition(scores[free], width - self.k, axis=1)[:, width - self.k] - 2 * 10.0**-S.SCORE_DIGITS
        row, column = np.nonzero(scores >= bar[:, None])
        if not len(row):
            return
        changed, at = np.unique(row, return_inverse=True)
        some = queries[changed]
        q = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        s = np.concatenate([self.scores[some].ravel(), np.round(scores[row, column], S.SCORE_DIGITS)])
        d = np.concatenate([self.docs[some].ravel(), docs[column]])
        order = np.lexsort((self.rank[d], -s, q))
        q, s, d = q[order], s[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(some)))[q]
        kept = place < self.k
        self.scores[some], self.docs[some] = s[kept].reshape(-1, self.k), d[kept].reshape(-1, self.k)
        self.floor[some] = np.maximum(self.floor[some], self.scores[some, -1])


def search_bundles(
    rows: DataFrame, bundles: Bundles, probes: DataFrame, k: int, blocks: int, *, vec: str, key: str, carry: Sequence[str] = ()
) -> DataFrame:
    """(qid, key, carried, score): per query and bundle the best ``k`` of the partitions that ``probes`` visit."""
    schema = S._hit_schema(rows, key, carry)
    arrow = S._arrow_schema(schema)
    names = [key, *carry]
    spans = bundles.spans
    placed = list(enumerate(zip(bundles.first.tolist(), bundles.shares.tolist())))
    dealt = rows.sparkSession.createDataFrame([(c, f, n) for c, (f, n) in placed], "_cell int, _first int, _shares int")
    left = rows.select(*names, vec, "_cell").join(F.broadcast(dealt), "_cell").select(
        *names, F.col(vec).alias("_vec"), "_cell", (F.col("_first") + F.pmod(F.xxhash64(key), "_shares")).cast("int").alias("_bundle"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    right = probes.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))

    def run(group: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return arrow.empty_table()
        query = S.pack(asked.select(["qid", "qvec"]))
        lo, hi = spans[group[0].as_py()]
        bits = np.frombuffer(b"".join(asked["_visited"].to_pylist()), np.uint8).reshape(len(query), -1)
        visited = np.unpackbits(bits, axis=1, count=hi - lo).astype(bool)
        cut = asked["cut"].to_numpy().astype(np.float64)
        docs = docs.sort_by([("_cell", "ascending")]).combine_chunks()
        cell = docs["_cell"].to_numpy()
        rank = np.empty(len(cell) + 1, np.int64)
        rank[np.asarray(pc.sort_indices(docs[key])).astype(np.int64)] = np.arange(len(cell))
        rank[-1] = len(cell)  # of no document
        matrix = S._vectors(docs["_vec"].chunk(0), query.matrix.shape[1])
        best = _Top(k, np.where(np.isnan(cut), -np.inf, cut), rank)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            part = np.flatnonzero(visited[:, cell[a] - lo])
            step = max(1, S.SCORE_CELLS // (b - a))
            for at in range(0, len(part), step):
                some = part[at : at + step]
                best.offer(some, np.arange(a, b), query.matrix[some] @ matrix[a:b].T)
        row, place = np.nonzero(best.docs >= 0)
        found = docs.select(names).take(pa.array(best.docs[row, place]))
        columns = {"qid": pa.array(query.ids[row]), "score": pa.array(best.scores[row, place])} | {n: found[n] for n in names}
        return pa.table([columns[f.name] for f in arrow], schema=arrow)

    by = ["_bundle", "_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def nearest_join(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vec: str = "vec",
    key: str = "pk",
    carry: Sequence[str] = (),
    n_pivots: int | None = None,
    docs_per_group: int | None = None,
    queries_per_group: int = QUERIES_PER_GROUP,
) -> DataFrame:
    """Per query the ``k`` documents of the largest inner product: (qid, key, carried, score, rank), exact.

    ``queries`` holds (qid long, qvec), both sides any number of rows. Equal scores go by ``key``,
    which must be unique. Without structure in the vectors no partition can be left out, and
    all documents meet all queries in bounded groups.
    """
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    spark = docs.sparkSession
    rows, pivots = partitioned(docs, k, vec, key, carry, n_pivots)
    if pivots is None:
        return S._final_top(spark.createDataFrame([], S._hit_schema(docs, key, carry)), key, k)
    everyone = written(queries.select(F.col("qid").cast("long"), "qvec"), "queries")
    once = everyone.groupBy("qvec").agg(F.min("qid").alias("qid")).select("qid", "qvec")
    once = written(once, "queries")
    per_group = docs_per_group or max(1, GROUP_VALUES // pivots.matrix.shape[1])
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate(pivots.n.tolist())], "_cell int, n bigint")
    home = written(_home_probes(once, pivots), "probes")
    first = search_groups(rows, sizes, home, k, vec=vec, key=key, carry=carry, docs_per_group=per_group, queries_per_group=queries_per_group)
    first = written(S._final_top(first, key, k).drop("rank"), "home_hits")
    cuts = first.groupBy(F.col("qid").alias("_q")).agg(F.min("score").alias("cut"), F.count(F.lit(1)).alias("_found"))
    known = once.join(cuts.where(F.col("_found") == k), F.col("qid") == F.col("_q"), "left").select("qid", "qvec", "cut")
    n, asked = int(pivots.n.sum()), once.count()
    bundles = Bundles(pivots.n, min(per_group, max(ROWS_PER_BUNDLE, -(-n // BUNDLES))))
    blocks = max(-(-asked // queries_per_group), min(BLOCKS, -(-asked // QUERIES_PER_BLOCK)), 1)
    rest = search_bundles(rows, bundles, _visits(known, pivots, bundles, k), k, blocks, vec=vec, key=key, carry=carry)
    found = S._final_top(first.unionByName(rest), key, k)
    same = everyone.withColumnRenamed("qid", "_asked").join(once.withColumnRenamed("qid", "_for"), "qvec").select("_asked", "_for")
    return found.join(same, F.col("qid") == F.col("_for")).select(F.col("_asked").alias("qid"), *[c for c in found.columns if c != "qid"])
