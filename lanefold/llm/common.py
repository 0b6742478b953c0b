"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanefold.session import scratch_path

SLICE_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names.

    What else a table holds, and how it is called, can then clash with nothing.
    """
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def shielded(
    docs: DataFrame,
    own: Sequence[str],
    added: Sequence[str],
    work: Callable[[DataFrame], DataFrame],
    dropped: Sequence[str] = (),
) -> DataFrame:
    """``work`` on the table with all columns but ``own`` under names that clash with nothing.

    The result has the table's columns without ``dropped`` ones, then those ``added``, which replace
    any of their names.
    """
    safe = [c if c in own else f"_column{i}" for i, c in enumerate(docs.columns)]
    done = work(docs.toDF(*safe))
    kept = [F.col(s).alias(c) for s, c in zip(safe, docs.columns) if c not in added and c not in dropped]
    return done.select(*kept, *added)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder once and read back from there.

    What was shuffled for them goes at once, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no label or language may be learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_of_each(rows: DataFrame, n: int, key: str, by: str) -> DataFrame:
    """At most ``n`` of the rows for each value of ``by``, chosen by a hash of ``key``.

    The sizes of the groups say which hashes can be among the first ``n``; only some ``2 * n`` rows
    of a group, however large it is, go on to be ranked.
    """
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size"))
    share = F.xxhash64(key) / F.lit(2.0**64) + F.lit(0.5)
    near = rows.join(F.broadcast(sizes), F.col(by) == F.col("_by")).where(share * F.col("_size") < 2 * n)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key), key))
    return near.withColumn("_place", place).where(F.col("_place") <= n).select(*rows.columns)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that hands freed memory back when it ends.

    Workers live on between tasks and stages; what their allocators keep would add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        released()

    return run


def forgetting(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``releasing`` task that needs no model: those that earlier steps left in the worker go first."""
    inner = releasing(work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from inner(batches)

    return run


def released() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_resident: dict[object, object] = {}
_kept: list[dict] = [_resident]


def keeping(store: dict) -> dict:
    """``store``, which a worker keeps between tasks until one of ``forgetting`` comes."""
    _kept.append(store)
    return store


def forget() -> None:
    """Drops models and stores of this worker."""
    for store in _kept:
        store.clear()


def resident(key: object, build: Callable[[], object]) -> object:
    """A model or table that a worker keeps between tasks, until it needs another one."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``max_bytes``; one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size, dtype=np.int64) // max_bytes
    starts = np.flatnonzero(np.diff(cut, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start up to its end, in turn."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the stretches that ``offsets`` bounds; 0 for an empty one."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
