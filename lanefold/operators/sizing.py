"""Bounds on what may reach the driver, and totals that survive a hot group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanefold.session import scratch_path

def collect_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """All rows when there are at most ``max_rows``; ``None`` when there are more.

    Counted first: a limit would send that many rows of every partition to one task.
    """
    return df.toArrow() if df.count() <= max_rows else None


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many tasks as there are cores.

    For costly per-row work on a file scan of few splits. A large one has enough of them
    and is left as it is, without a shuffle. Meant for scans: counting the splits of
    anything that shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table in the shared scratch folder.

    For a relation that is used several times and costly to derive. Its files outlive the
    executors that wrote them, and later reads still prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, weight: Column | None = None
) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 by default) per ``keys`` in ``order``.

    ``order`` must be unique within a key. Rows are range-partitioned on keys and order, so
    that a hot key spreads over many tasks: each range gets its own running sum, and the sums of
    the ranges before it are added. The only per-key window left is over at most one row per
    range. Only keys, order and weight go that way; what else a row holds is joined afterwards.
    """
    keys, order = list(keys), list(order)
    amount = F.lit(1).cast("long") if weight is None else weight
    names = list(dict.fromkeys([*keys, *order]))
    ranged = written(
        df.select(*names, amount.alias("_w")).repartitionByRange(*names).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_of_range"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    summed = ranged.withColumn(
        "_sum", F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    on = summed["_range"] == offsets["_of_range"]
    for k in keys:
        on = on & summed[k].eqNullSafe(offsets[f"_k_{k}"])
    placed = summed.join(offsets, on).select(*names, (F.col("_sum") + F.col("_offset")).alias(out))
    rest = [c for c in df.columns if c not in names and c != out]
    if not rest:
        return placed
    mine = placed.select(*[F.col(c).alias(f"_p_{c}") for c in names], out)
    on = reduce(and_, [df[c].eqNullSafe(mine[f"_p_{c}"]) for c in names])
    return df.drop(out).join(mine, on).select(*[c for c in df.columns if c != out], out)


def dense_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position per ``keys`` in ``order``."""
    return running_total(df, keys, order, out).withColumn(out, F.col(out) - 1)
