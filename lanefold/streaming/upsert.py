"""Incremental ingest: a file stream into a table keyed by primary key.

The table is cut into buckets by key. A version is a manifest that names the folder of each bucket; a
batch writes new folders for the buckets it touches, and commits by renaming the next
manifest into place. Readers see one version, and one row per key in it, without looking at batches.
A batch that fails before its rename leaves folders that no manifest names; one that has
been committed changes nothing when it is run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.frames import upsert
from lanefold.operators.sizing import written
from lanefold.session import scratch_path

BUCKETS = 64


class KeyedTable:
    """A folder with ``data/`` (one folder per bucket and the batch that wrote it) and ``versions/``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.manifest = self._latest() or {"version": 0, "batch": -1, "buckets": buckets, "schema": None, "folders": {}}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        files, folder = self._files(), self._path("versions")
        if not files.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = files.open(self._path("versions", names[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """The manifest in place, whole or not at all; an error if another writer was first."""
        files = self._files()
        name = f"{manifest['version']:020d}.json"
        draft, final = self._path("versions", f"_{uuid.uuid4().hex}"), self._path("versions", name)
        out = files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")
        self.manifest = manifest

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.manifest["buckets"])).cast("int"))

    def _read(self, folders: Sequence[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def rows(self) -> DataFrame:
        """The rows of the newest version, one per key."""
        self.manifest = self._latest() or self.manifest
        if self.manifest["schema"] is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return self._read(sorted(set(self.manifest["folders"].values())), self.manifest["schema"])

    def merge(self, batch: DataFrame, batch_id: int, order: str) -> bool:
        """The batch's rows in place of those with their keys, the highest ``order`` of a key winning; False if it was there already.

        Only the buckets of its keys are read and written again.
        """
        now = self._latest() or self.manifest
        self.manifest = now
        if batch_id <= now["batch"]:
            return False
        schema = now["schema"] or batch.schema.json()
        incoming = written(self._bucketed(batch), "incoming")
        touched = sorted(r["_bucket"] for r in incoming.select("_bucket").distinct().collect())
        stored = self._read([now["folders"][str(b)] for b in touched if str(b) in now["folders"]], schema)
        ranked = incoming.drop("_bucket").withColumn("_order", F.col(order))
        merged = upsert(stored.withColumn("_order", F.lit(None).cast(incoming.schema[order].dataType)), ranked, self.keys, "_order")
        folder = f"{now['version'] + 1:020d}-{uuid.uuid4().hex}"
        rows = self._bucketed(merged.select(*batch.columns)).repartition("_bucket", *self.keys)
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._commit({**now, "version": now["version"] + 1, "batch": batch_id, "schema": schema, "folders": folders})
        return True


def start(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str,
    files_per_batch: int | None = None,
    buckets: int = BUCKETS,
):
    """Take in the files not yet seen, then stop. Returns the streaming query.

    ``source`` is a folder, or a pattern such as ``/data/[e]vents.parquet``.
    """
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    table = KeyedTable(spark, target, keys, buckets)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(lambda df, i: table.merge(df, i, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The table's rows, one per key."""
    return KeyedTable(spark, target, keys).rows()


def replay(spark: SparkSession, source: str, keys: Sequence[str], order: str) -> DataFrame:
    """A finished run of the stream over ``source``, read back."""
    target = scratch_path(spark, "upsert")
    query = start(spark, source, target, scratch_path(spark, "upsert-progress"), keys, order)
    query.awaitTermination()
    return current(spark, target, keys)
