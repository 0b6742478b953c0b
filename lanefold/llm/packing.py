"""Best-fit decreasing packing of token sequences.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them. Tasks
count their lengths; the counts, not the pieces, are packed, longest first: a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and all pieces of a
length that go to bins of one kind are placed in one step. Filling a bin at least halves what
remains of it, so that the placements number some ``24 * capacity`` at most, however many
pieces there are. A piece then finds its place from its rank among those of its length. The
result is that of best-fit decreasing over the whole corpus, not over blocks of it.

Null texts count as empty (a document of its end mark alone); repeated rows are packed as
often as they occur; other columns are ignored; ``doc_id`` is only carried along. An empty table
gives an empty result. A text of any length is cut, never dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, releasing, slices, stored, text_column
from lanefold.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1


class Placement(NamedTuple):
    """``bins`` sequences from ``sequence`` on get ``each`` pieces of ``length``, at ``offset`` first."""

    length: int
    rank: int  # of the first piece among those of its length
    bins: int
    each: int
    sequence: int
    offset: int


class OpenBins:
    """Open bins by what remains of them, with a segment tree over the remaining capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _set(self, remaining: int) -> None:
        at = self.size + remaining
        self.tree[at] = bool(self.bins[remaining])
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def put(self, remaining: int, first: int, n: int) -> None:
        if n and remaining:
            self.bins[remaining].append((first, n))
            self._set(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        got = self.bins[remaining].pop()
        self._set(remaining)
        return got

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = self.size + length
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Where the pieces of each length go; every length is from 1 to ``capacity``."""
    out: list[Placement] = []
    open_bins, sequences = OpenBins(capacity), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = open_bins.tightest(length)
            if remaining is None:
                remaining = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_bins.take(remaining)
            # The bin just served is the tightest until it holds no further piece.
            each = remaining // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            for at, bins, pieces in ((first, full, each), (first + full, 1, rest)):
                if bins and pieces:
                    out.append(Placement(length, rank, bins, pieces, at, capacity - remaining))
                    open_bins.put(remaining - pieces * length, at, bins)
                    rank += bins * pieces
                    left -= bins * pieces
            used = full + bool(rest)
            open_bins.put(remaining, first + used, n - used)
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): what is to be packed.

    ``nth`` numbers the pieces of one length within the task that made them.
    """

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                row, number, start, length, crc, nth = [], [], [], [], [], []
                for i, ids in enumerate(encoder(path).encode(text_column(part))):
                    ids += end_id.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        row.append(i)
                        number.append(k)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        nth.append(made[n])
                        made[n] += 1
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.repeat(pa.scalar(task, pa.int64()), len(row)),
                        pa.array(nth, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"
    )


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset, for pieces as ``pieces`` makes them.

    ``made`` must give the same rows each time (a written table), as it is read twice.
    """
    spark = made.sparkSession
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("task").alias("of_task"),
        F.col("length").alias("of_length"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = best_fit_decreasing({r["length"]: r["n"] for r in lengths}, capacity)
    placements = spark.sparkContext.broadcast(np.array(sorted(plan), dtype=np.int64).reshape(-1, 6))

    @releasing
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, each, sequence, offset = placements.value.T
        key = (length << 44) | rank
        for batch in batches:
            n = batch.column("length").to_numpy()
            mine = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (n << 44) | mine, side="right") - 1
            k = mine - rank[at]
            yield pa.record_batch(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(sequence[at] + k // each[at]),
                    pa.array(offset[at] + k % each[at] * n),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = made.schema["doc_id"].dataType.simpleString()
    ranked = made.join(first, (F.col("task") == F.col("of_task")) & (F.col("length") == F.col("of_length")))
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    ).mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents in as few sequences as best-fit decreasing finds, one row per piece."""
    return pack(stored(pieces(docs, path, capacity, end_id), "pieces"), capacity)
