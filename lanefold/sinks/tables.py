"""Table writers."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.identifiers import compact_utc
from lanefold.functions.vectors import NORM_TOLERANCE, checked_width, norm_deviation
from lanefold.operators.sizing import dense_ordinal
from lanefold.schemas import LEDGER


def checked_unit(vec: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    """The vector; an error where its norm is not 1 within the tolerance."""
    off = norm_deviation(vec)
    return F.when(off <= tolerance, vec).otherwise(
        F.raise_error(F.concat(F.lit("vector norm deviates from 1 by "), off.cast("string")))
    )


def write_vectors(images: DataFrame, embedder, out: str) -> int:
    """Encode images (path, content) into (row, frame_id, path, vec); returns the number of rows.

    Rows are numbered by path. The norm and width of every vector are checked as it is written.
    """
    numbered = dense_ordinal(images, [], ["path"], "row")
    vec = checked_unit(checked_width(embedder.encode_image(F.col("content")), embedder.dim, embedder.model_id))
    frame = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    numbered.select("row", frame.alias("frame_id"), "path", vec.alias("vec")).write.mode("overwrite").parquet(out)
    return images.sparkSession.read.parquet(out).count()


def write_index(frames: DataFrame, out: str, cluster_by: Sequence[str] = ("video_id", "frame_idx")) -> None:
    """The collection as Parquet, clustered so that filters on a video skip files and row groups."""
    frames.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by).write.mode("overwrite").parquet(out)


ROWS_PER_FILE = 250_000


def write_cells(index: DataFrame, sizes: DataFrame, out: str, key: str = "pk", rows_per_file: int = ROWS_PER_FILE) -> None:
    """An index with ``cell``, one folder per cell; ``sizes`` (cell, n) says into how many files a cell goes."""
    parts = sizes.select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / rows_per_file).cast("int").alias("_files"))
    dealt = index.join(parts, F.col("cell") == F.col("_cell")).withColumn("_file", F.pmod(F.xxhash64(key), "_files"))
    dealt.repartition("cell", "_file").drop("_cell", "_files", "_file").write.partitionBy("cell").parquet(out)


def write_pairs(pairs: DataFrame, out: str) -> int:
    """A contrastive corpus; returns the number of pairs. An empty one is an error."""
    pairs.select("anchor_clean", "positive_noisy", "mode", "hard_negs").write.mode("overwrite").parquet(out)
    n = pairs.sparkSession.read.parquet(out).count()
    if n == 0:
        raise ValueError("no clean strings collected")
    return n


@dataclasses.dataclass(frozen=True)
class Run:
    run_id: str
    git_sha: str
    job_name: str
    started_at: object
    finished_at: object = None
    exit_code: int | None = None
    prefix: str = ""
    blobs: tuple[str, ...] = ()
    env: dict | None = None


def append_run(spark: SparkSession, run: Run, ledger: str) -> None:
    """One more file in the ledger, in a folder named so that names sort by start time."""
    row = {**dataclasses.asdict(run), "blobs": list(run.blobs), "env": run.env or {}}
    entry = spark.createDataFrame([tuple(row[f.name] for f in LEDGER)], LEDGER)
    stamp = entry.select(compact_utc(F.col("started_at"))).first()[0]
    entry.coalesce(1).write.mode("overwrite").json(f"{ledger}/{stamp}-{run.run_id}")
