"""The run ledger and object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.ledger import tail
from lanefold.schemas import LEDGER
from lanefold.sources.vectors import files


def read_ledger(spark: SparkSession, path: str, limit: int = 100, job: str | None = None) -> DataFrame:
    """The most recent ``limit`` runs (0: all), ascending by start. Failed runs are included."""
    return tail(spark.read.schema(LEDGER).json(path), limit, job)


def object_keys(spark: SparkSession, root: str) -> DataFrame:
    """(key, length) of every object below ``root``, keys relative to it."""
    listing = files(spark, root, "*", recursive=True)
    base = root.rstrip("/") + "/"
    key = F.substring_index("path", base, -1)
    return listing.select(key.alias("key"), "length").orderBy("key")
