"""Top-k search by inner product over vector and token-vector columns.

A query set of proven small size travels to every task; each task scans its share of the
documents with matrix products and keeps k hits per query, so that only
``tasks x queries x k`` rows are shuffled, however the documents are distributed. A larger
query set is cut into blocks, and every (document block, query block) cell is one group of
bounded size. Both ways are exact. Equal scores are ordered by document key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanefold.operators.sizing import collect_bounded, written


MERGE_SHARES = 64
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_VALUES = 16_000_000
CELL_VALUES = 32_000_000  # numbers held by one cell, per side
SCORE_DIGITS = 12  # equal vectors tie, whatever block a product was computed in
SCORE_CELLS = 4_000_000


@dataclass
class QueryPack:
    """A bounded set of query vectors; token queries hold one row per token."""

    ids: np.ndarray
    matrix: np.ndarray
    starts: np.ndarray | None = None  # first token row of each query

    def __len__(self) -> int:
        return len(self.ids)


def pack(table: pa.Table, tokens: bool = False) -> QueryPack:
    """(id, vector) or (id, token vectors) rows as one matrix."""
    table = table.combine_chunks()
    ids = np.asarray(table.column(0).cast(pa.int64()))
    column = table.column(1)
    vectors = column.chunk(0) if column.num_chunks else pa.array([], type=column.type)
    starts = None
    if tokens:
        counts = np.diff(np.asarray(vectors.offsets))
        if len(ids) and counts.min() == 0:
            raise ValueError("a query without tokens cannot be scored")
        starts = np.cumsum(counts) - counts
        vectors = vectors.flatten()
    widths = set(np.diff(np.asarray(vectors.offsets)).tolist())
    if len(widths) > 1:
        raise ValueError(f"query vectors of different widths: {sorted(widths)}")
    dim = widths.pop() if widths else 0
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return QueryPack(ids, flat.reshape(len(vectors), dim), starts)


@dataclass
class Best:
    """The best k hits per query seen so far in one task."""

    k: int
    n: int
    rows: list[list[tuple]] = field(init=False)
    floor: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.rows = [[] for _ in range(self.n)]
        self.floor = np.full(self.n, -np.inf)

    def offer(self, queries: np.ndarray, scores: np.ndarray, payload: Callable[[int], tuple]) -> None:
        """Scores of documents (columns) for the given queries (rows)."""
        width = scores.shape[1]
        bar = self.floor[queries]
        if width > self.k:
            bar = np.maximum(bar, np.partition(scores, width - self.k, axis=1)[:, width - self.k])
        bar = bar - 2 * 10.0**-SCORE_DIGITS
        for row in np.flatnonzero((scores >= bar[:, None]).any(axis=1)).tolist():
            q = int(queries[row])
            at = np.flatnonzero(scores[row] >= bar[row])
            found = np.round(scores[row, at], SCORE_DIGITS)
            kept = self.rows[q] + [(-s, *payload(j)) for s, j in zip(found.tolist(), at.tolist())]
            kept.sort(key=lambda hit: hit[:2])
            self.rows[q] = kept[: self.k]
            if len(kept) >= self.k:
                self.floor[q] = -self.rows[q][-1][0]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten())
    if len(flat) != len(column) * dim:
        raise ValueError(f"dim mismatch: expected vectors of width {dim}")
    return flat.reshape(-1, dim).astype(np.float64)


def dense_scores(query: QueryPack, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    docs = _vectors(column, query.matrix.shape[1])
    step = max(1, SCORE_CELLS // max(1, len(docs)))
    for at in range(0, len(query), step):
        part = np.arange(at, min(at + step, len(query)))
        yield part, query.matrix[part] @ docs.T


def late_interaction_scores(
    query: QueryPack, column: pa.Array
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mean over query tokens of the best dot product with any document token.

    Documents without tokens score 0. Token arrays are ragged; there is no padding.
    """
    counts = np.diff(np.asarray(column.offsets))
    tokens = _vectors(column.flatten(), query.matrix.shape[1])
    filled = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[filled]
    ends = np.append(query.starts, len(query.matrix))
    widest = int(np.diff(ends).max()) if len(query) else 1
    step = max(1, SCORE_CELLS // max(1, len(tokens) * widest))
    for at in range(0, len(query), step):
        part = np.arange(at, min(at + step, len(query)))
        lo, hi = ends[part[0]], ends[part[-1] + 1]
        out = np.zeros((len(part), len(counts)))
        if len(filled):
            best = np.maximum.reduceat(query.matrix[lo:hi] @ tokens.T, starts, axis=1)
            sums = np.add.reduceat(best, ends[part] - lo, axis=0)
            out[:, filled] = sums / np.diff(ends)[part][:, None]
        yield part, out


SCORERS = {"dense": dense_scores, "late_interaction": late_interaction_scores}


def _hit_schema(docs: DataFrame, key: str, carry: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", T.LongType()),
            docs.schema[key],
            *[docs.schema[c] for c in carry],
            T.StructField("score", T.DoubleType()),
        ]
    )


def _hits(best: Best, query: QueryPack, names: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    flat = [(int(query.ids[q]), *hit) for q, hits in enumerate(best.rows) for hit in hits]
    columns = {"qid": [h[0] for h in flat], "score": [-h[1] for h in flat]}
    for j, name in enumerate(names):
        columns[name] = [h[2 + j] for h in flat]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _final_top(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The best k of each query: first within shares of its hits, then over what those leave.

    Each task hands in up to k hits per query, so one query can have any number of them.
    """
    best = [F.desc("score"), F.asc(key)]
    share = Window.partitionBy("qid", F.pmod(F.hash(key), F.lit(MERGE_SHARES))).orderBy(*best)
    few = hits.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    whole = Window.partitionBy("qid").orderBy(*best)
    return few.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= k)


def _scan(
    docs: DataFrame, query: QueryPack, k: int, key: str, carry: Sequence[str], vec: str, scorer: str
) -> DataFrame:
    schema = _hit_schema(docs, key, carry)
    arrow = _arrow_schema(schema)
    names = [key, *carry]
    shared = docs.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = shared.value
        best = Best(k, len(pack))
        for batch in batches:
            if not batch.num_rows or not len(pack):
                continue
            cells = [batch.column(n) for n in names]
            payload = partial(lambda cells, j: tuple(c[j].as_py() for c in cells), cells)
            for part, scores in SCORERS[scorer](pack, batch.column(vec)):
                best.offer(part, scores, payload)
        yield _hits(best, pack, names, arrow)

    return docs.select(*names, vec).mapInArrow(run, schema)


def _cells(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    carry: Sequence[str],
    vec: str,
    scorer: str,
    queries_per_cell: int,
    docs_per_cell: int,
) -> DataFrame:
    """Every document block meets every query block in one cell of bounded size."""
    schema = _hit_schema(docs, key, carry)
    arrow = _arrow_schema(schema)
    names = [key, *carry]
    n_docs = max(1, -(-docs.count() // docs_per_cell))
    n_queries = max(1, -(-queries.count() // queries_per_cell))
    left = docs.select(
        *names,
        vec,
        F.pmod(F.xxhash64(key), F.lit(n_docs)).alias("_d"),
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("_q"),
    )
    right = queries.select(
        "qid",
        "qvec",
        F.explode(F.expr(f"sequence(0L, {n_docs - 1}L)")).alias("_d"),
        F.pmod(F.xxhash64("qid"), F.lit(n_queries)).cast("int").alias("_q"),
    )

    def run(key_: tuple, some_docs: pa.Table, some_queries: pa.Table) -> pa.Table:
        query = pack(some_queries.select(["qid", "qvec"]), scorer == "late_interaction")
        best = Best(k, len(query))
        for batch in some_docs.combine_chunks().to_batches():
            cells = [batch.column(n) for n in names]
            payload = partial(lambda cells, j: tuple(c[j].as_py() for c in cells), cells)
            if len(query) and batch.num_rows:
                for part, scores in SCORERS[scorer](query, batch.column(vec)):
                    best.offer(part, scores, payload)
        return pa.Table.from_batches([_hits(best, query, names, arrow)])

    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(run, schema)


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vec: str = "vec",
    key: str = "pk",
    carry: Sequence[str] = (),
    where: Column | str | None = None,
    scorer: str = "dense",
    dim: int | None = None,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    docs_per_cell: int | None = None,
) -> DataFrame:
    """Per query the ``k`` best documents: (qid, key, carried columns, score, rank).

    ``queries`` holds (qid long, qvec). ``where`` restricts the documents before ranking.
    ``key`` must be unique. Fewer than ``k`` documents give fewer hits.
    """
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    if vec not in docs.columns:
        raise ValueError(f"unknown vector column {vec!r}; have {', '.join(docs.columns)}")
    if where is not None:
        docs = docs.where(where)
    queries = queries.select(F.col("qid").cast("long"), "qvec")
    tokens = scorer == "late_interaction"
    if dim is not None and not tokens:
        # the width is known, so a bound on rows is a bound on size
        bound = min(max_broadcast_queries, MAX_BROADCAST_VALUES // dim)
        few = collect_bounded(queries, bound)
        n_queries, values = (few.num_rows, 0) if few is not None else _measured(queries, tokens, dim)
    else:
        queries = written(queries, "queries")  # encoded once, then measured and read
        n_queries, values = _measured(queries, tokens, dim)
        fits = n_queries <= max_broadcast_queries and values <= MAX_BROADCAST_VALUES
        few = queries.toArrow() if fits else None
    if few is not None:
        query = pack(few, tokens)
        if dim is not None and len(query) and query.matrix.shape[1] != dim:
            raise ValueError(
                f"query dim mismatch for field {vec!r}: expected {dim}, got {query.matrix.shape[1]}"
            )
        return _final_top(_scan(docs, query, k, key, carry, vec, scorer), key, k)
    queries_per_cell = min(max_broadcast_queries, CELL_VALUES * n_queries // values)
    if not tokens:
        from lanefold.operators.pivots import QUERIES_PER_GROUP, nearest_join

        most = QUERIES_PER_GROUP * max_broadcast_queries // MAX_BROADCAST_QUERIES
        queries_per_group = max(1, min(most, CELL_VALUES * n_queries // values))
        return nearest_join(
            docs, queries, k, vec=vec, key=key, carry=carry, docs_per_group=docs_per_cell, queries_per_group=queries_per_group
        )
    if docs_per_cell is None:
        n_docs, doc_values = _measured(docs.select(key, F.col(vec).alias("qvec")), tokens, dim)
        docs_per_cell = CELL_VALUES * n_docs // max(1, doc_values)
    cells = _cells(
        docs, queries, k, key, carry, vec, scorer, max(1, queries_per_cell), max(1, docs_per_cell)
    )
    return _final_top(cells, key, k)


def _measured(vectors: DataFrame, tokens: bool, dim: int | None) -> tuple[int, int]:
    """(rows, numbers) of a relation of vectors. Vectors of declared width are only counted."""
    if dim is not None and not tokens:
        rows = vectors.count()
        return rows, rows * dim
    size = F.size("qvec")
    if tokens:
        size = F.aggregate("qvec", F.lit(0), lambda n, t: n + F.size(t))
    found = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return found[0], found[1]


_TERM = re.compile(
    r"""\s*(?:(?P<word>and|or|not|in|like)\b|(?P<op>==|!=|>=|<=|>|<|\(|\)|\[|\]|,)
        |(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
        |(?P<name>[A-Za-z_]\w*))""",
    re.X | re.I,
)


def filter_sql(expr: str, columns: Sequence[str]) -> str:
    """A scalar filter of the vector-store dialect as a Spark SQL condition.

    Only comparisons of the given columns with literals, joined by and, or, not and
    parentheses, pass; anything else is an error, so that no foreign text reaches the parser.
    """
    out, at, after_operand = [], 0, False
    while at < len(expr.rstrip()):
        found = _TERM.match(expr, at)
        if not found:
            raise ValueError(f"cannot read filter at {expr[at:]!r}")
        at = found.end()
        operand = bool(found["num"] or found["str"] or found["name"])
        if after_operand and (operand or found["op"] in ("(", "[")):
            raise ValueError(f"cannot read filter at {found.group()!r}")
        after_operand = operand
        if found["word"]:
            out.append(found["word"].upper())
        elif found["op"]:
            out.append({"==": "=", "!=": "<>", "[": "(", "]": ")"}.get(found["op"], found["op"]))
        elif found["num"]:
            out.append(found["num"])
        elif found["str"]:
            body = re.sub(r"\\(.)", r"\1", found["str"][1:-1])
            out.append("'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif found["name"] in columns:
            out.append(f"`{found['name']}`")
        else:
            raise ValueError(f"unknown field {found['name']!r} in filter")
    return " ".join(out)
