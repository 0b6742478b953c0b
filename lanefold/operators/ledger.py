"""The run ledger, and checks that inputs are there before a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail(ledger: DataFrame, limit: int = 100, job: str | None = None, order: Sequence[str] = ("started_at", "run_id")) -> DataFrame:
    """The most recent ``limit`` runs (0: all) of one job or of all, in ascending order."""
    if job is not None:
        ledger = ledger.where(F.col("job_name") == job)
    if limit:
        ledger = ledger.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return ledger.orderBy(*order)


def tail_per_job(ledger: DataFrame, limit: int, order: Sequence[str] = ("started_at", "run_id")) -> DataFrame:
    """The most recent ``limit`` runs of every job."""
    from pyspark.sql import Window

    spec = Window.partitionBy("job_name").orderBy(*[F.desc(c) for c in order])
    return ledger.withColumn("_n", F.row_number().over(spec)).where(F.col("_n") <= limit).drop("_n")


def prefix_counts(keys: DataFrame, prefixes: Sequence[str], key: str = "key") -> DataFrame:
    """(ord, prefix, n_found): objects below each distinct prefix, in the order first given.

    A prefix is matched as a string. All prefixes are counted in one pass over the keys.
    """
    distinct = list(dict.fromkeys(prefixes))
    if not distinct:
        return keys.sparkSession.createDataFrame([], "ord int, prefix string, n_found long")
    counts = keys.agg(
        *[F.count_if(F.startswith(F.col(key), F.lit(p))).alias(f"n{i}") for i, p in enumerate(distinct)]
    )
    found = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(p).alias("prefix"), F.col(f"n{i}").alias("n_found"))
            for i, p in enumerate(distinct)
        ]
    )
    return counts.select(F.inline(found))


def preflight(keys: DataFrame, prefixes: Sequence[str], key: str = "key") -> DataFrame:
    """One row: whether every prefix has an object, and those that have none. True without prefixes."""
    counts = prefix_counts(keys, prefixes, key)
    return counts.agg(
        F.coalesce(F.bool_and(F.col("n_found") > 0), F.lit(True)).alias("ok"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("n_found") == 0, F.struct("ord", "prefix")))),
            lambda s: s["prefix"],
        ).alias("missing"),
    )


class PreflightError(RuntimeError):
    """Some required prefixes hold no object."""

    def __init__(self, missing: Sequence[str]) -> None:
        super().__init__("missing input prefixes: " + ", ".join(missing))
        self.missing = list(missing)


def require_prefixes(keys: DataFrame, prefixes: Sequence[str], key: str = "key") -> None:
    row = preflight(keys, prefixes, key).first()
    if not row["ok"]:
        raise PreflightError(row["missing"])


def first_with_suffix(keys: DataFrame, prefix: str, suffix: str, key: str = "key") -> DataFrame:
    """The lowest key under ``prefix`` that ends in ``suffix``."""
    return keys.where(F.startswith(F.col(key), F.lit(prefix)) & F.endswith(F.col(key), F.lit(suffix))).agg(
        F.min(key).alias(key)
    )
