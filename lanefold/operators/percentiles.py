"""Exact percentiles of any number of values per group.

A percentile is made of order statistics. Equal values are counted on the map side, a
running total over the counts gives each value its place, and one aggregate picks the
values at the wanted places. No group is ever held in one aggregation buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.operators.sizing import running_total, written


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    places: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per group: ``n``, the mean, and the value at each 0-based place, given as a function of n."""
    if not by:
        whole = order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, places)
        return whole.drop("_all")
    by = list(by)
    counted = written(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count")),
        "value-counts",
    )
    sizes = counted.groupBy(*by).agg(
        F.sum("_count").alias("n"),
        (F.sum(F.col(value) * F.col("_count")) / F.sum("_count")).alias("mean"),
    )
    placed = running_total(
        counted, by, [value], "_through", F.col("_count")
    )
    joined = placed.join(sizes, by)  # a hot group's values are split by the skew join
    picks = []
    for name, place in places.items():
        at = place(F.col("n")).cast("long")
        here = (F.col("_through") > at) & (F.col("_through") - F.col("_count") <= at)
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return joined.groupBy(*by, "n", "mean").agg(*picks)


def _interpolation(p: float) -> dict[str, Callable[[Column], Column]]:
    return {
        "lo": lambda n: F.floor((n - 1) * F.lit(p)),
        "hi": lambda n: F.least(F.floor((n - 1) * F.lit(p)) + 1, n - 1),
    }


def latency_stats(
    df: DataFrame, by: Sequence[str], value: str
) -> DataFrame:
    """Per group: n, mean and linearly interpolated p50, p95, p99. All zero for no values at all."""
    targets = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    places = {
        f"_{name}_{side}": place
        for name, p in targets.items()
        for side, place in _interpolation(p).items()
    }
    stats = order_statistics(df, by, value, places)
    columns = []
    for name, p in targets.items():
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        exact = (F.col("n") - 1) * F.lit(p)
        columns.append((lo + (hi - lo) * (exact - F.floor(exact))).alias(f"{name}_ms"))
    out = stats.select(*by, F.col("n"), F.col("mean").alias("mean_ms"), *columns)
    if by:
        return out
    filled = df.sparkSession.range(1).join(out, F.lit(True), "left")
    return filled.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns])


def upper_median_and_p95(
    df: DataFrame, by: Sequence[str], value: str
) -> DataFrame:
    """Nearest rank: p50 at place n // 2, p95 at round(0.95 (n - 1)), halves to even."""
    return order_statistics(
        df,
        by,
        value,
        {
            "p50_ms": lambda n: F.floor(n / 2),
            "p95_ms": lambda n: F.least(n - 1, F.bround((n - 1) * F.lit(0.95), 0)),
        },
    )


def true_median_and_p95(
    df: DataFrame, by: Sequence[str], value: str
) -> DataFrame:
    """Median as the mean of the middle values; p95 at round(0.95 n) - 1, halves to even."""
    stats = order_statistics(
        df,
        by,
        value,
        {
            "_lo": lambda n: F.floor((n - 1) / 2),
            "_hi": lambda n: F.floor(n / 2),
            "p95_ms": lambda n: F.greatest(F.lit(0), F.bround(n * F.lit(0.95), 0) - 1),
        },
    )
    return stats.withColumn("p50_ms", (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def medians(
    df: DataFrame, by: Sequence[str], value: str
) -> DataFrame:
    """Per group the median, as (by..., median)."""
    stats = true_median_and_p95(df, by, value)
    return stats.select(*by, F.col("p50_ms").alias("median"))
