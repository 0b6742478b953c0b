"""Vector matrices (``.npy``) with their manifests, and pre-extracted feature stores."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.vectors import l2_normalise
from lanefold.operators.frames import metadata_key
from lanefold.operators.sizing import dense_ordinal
from lanefold.schemas import KEYFRAME_META

ROWS_PER_BATCH = 2048
RANGE_BYTES = 32 << 20
RANGED = ("file", "hdfs", "s3", "s3a", "gs")


def _stem(path: str = "path"):
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.(manifest\.jsonl|npy)$", "")


def files(spark: SparkSession, root: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, length) of matching files; their bytes are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", "length")
    )


class Header(NamedTuple):
    """What the head of a ``.npy`` file says about its values."""

    offset: int
    dtype: np.dtype
    by_column: bool
    rows: int
    width: int
    ndim: int


def read_header(file: BinaryIO) -> Header:
    """The header of an open ``.npy`` file; a vector is a matrix of one row."""
    version = np.lib.format.read_magic(file)
    readers = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    if version not in readers:
        raise ValueError(f"unsupported .npy version {version}")
    shape, by_column, dtype = readers[version](file)
    if dtype.hasobject or len(shape) > 2:
        raise ValueError(f"not a matrix of numbers: {dtype} of shape {shape}")
    rows, width = ((1,) * (2 - len(shape)) + shape)[-2:]
    return Header(file.tell(), dtype, by_column and len(shape) == 2, rows, width, len(shape))


def read_rows(file: BinaryIO, header: Header, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop``, read from their places in the file only."""

    def values(place: int, n: int) -> np.ndarray:
        file.seek(header.offset + place * header.dtype.itemsize)
        raw = file.read(n * header.dtype.itemsize)
        if len(raw) < n * header.dtype.itemsize:
            raise ValueError("file ends before its last row")
        return np.frombuffer(raw, header.dtype).astype(np.float32)

    n = stop - start
    if header.by_column:
        columns = [values(c * header.rows + start, n) for c in range(header.width)]
        return np.stack(columns, axis=1) if columns else np.zeros((n, 0), np.float32)
    return values(start * header.width, n * header.width).reshape(n, header.width)


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place, on the machine's own or a remote file system."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = pafs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return system.open_input_file(name)


_ROWS = "video_id string, row long, ndim int, vec array<float>"
_ARROW_ROWS = pa.schema([("video_id", pa.string()), ("row", pa.int64()), ("ndim", pa.int32()), ("vec", pa.list_(pa.float32()))])


def _batches(name: str, file: BinaryIO, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of an open file from ``start`` to ``stop``, ``ROWS_PER_BATCH`` at a time."""
    header = read_header(file)
    stop = header.rows if stop is None else stop
    for at in range(start, stop, ROWS_PER_BATCH):
        part = read_rows(file, header, at, min(at + ROWS_PER_BATCH, stop))
        n, width = part.shape
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(part.ravel()))
        columns = [pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.array(np.full(n, header.ndim, dtype=np.int32)), vectors]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_ROWS)


def _read_whole(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """``read_matrices`` with one file per task at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("video_id").to_pylist(), batch.column("content")):
                yield from _batches(name, io.BytesIO(raw.as_py()))

    content = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npy")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select(_stem().alias("video_id"), "content")
    )
    return content.mapInArrow(read, _ROWS)


def read_matrices(
    spark: SparkSession, root: str, recursive: bool = False, range_bytes: int = RANGE_BYTES, ranged: Sequence[str] = RANGED
) -> DataFrame:
    """(video_id, row, ndim, vec): the rows of every matrix.

    Headers are read first. What a task then reads are ranges of rows of about ``range_bytes``, so a file of
    any size is spread over many tasks and is in memory nowhere; a range is read by ``ROWS_PER_BATCH``.
    File systems that only Spark can open, those not ``ranged``, are read by whole files.
    """
    listed = files(spark, root, "*.npy", recursive)
    known = listed.agg(F.sum("length").alias("size"), F.min("path").alias("path")).first()
    if known["path"] and not known["path"].startswith(tuple(f"{scheme}:" for scheme in ranged)):
        return _read_whole(spark, root, recursive)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str, int, int]] = []
            for name, path in zip(batch.column("video_id").to_pylist(), batch.column("path").to_pylist()):
                with opened(path) as file:
                    header = read_header(file)
                step = max(1, range_bytes // max(1, header.width * header.dtype.itemsize))
                found += [(name, path, at, min(at + step, header.rows)) for at in range(0, header.rows, step)]
            columns = zip(*found) if found else ((),) * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["video_id", "path", "start", "stop"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                with opened(task["path"]) as file:
                    yield from _batches(task["video_id"], file, task["start"], task["stop"])

    tasks = listed.select(_stem().alias("video_id"), "path").mapInArrow(ranges, "video_id string, path string, start long, stop long")
    # A set number of partitions: rows this small would else be put together in one task.
    spread = tasks.repartition(max(1, -(-(known["size"] or 0) // range_bytes)))
    return spread.mapInArrow(read, _ROWS)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(video_id, row, frame_id, path): place in line order, whatever the row field says."""
    lines = spark.read.option("pathGlobFilter", "*.manifest.jsonl").text(root).select(
        _stem("_metadata.file_path").alias("video_id"),
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    numbered = dense_ordinal(lines.where(F.trim("value") != ""), ["video_id"], ["block", "at"], "row")
    fields = F.from_json("value", "frame_id string, path string")
    return numbered.select("video_id", "row", fields["frame_id"].alias("frame_id"), fields["path"].alias("path"))


def read_lane(spark: SparkSession, index_root: str, lane: str, dim: int | None = None) -> DataFrame:
    """(lane, video_id, row, frame_id, path, vec) of ``<index_root>/<lane>/<video>.npy`` and manifests."""
    matrices = read_matrices(spark, f"{index_root}/{lane}")
    manifests = read_manifests(spark, f"{index_root}/{lane}")
    joined = matrices.join(manifests.withColumn("listed", F.lit(True)), ["video_id", "row"], "full")
    mismatch = F.raise_error(
        F.concat(F.lit(f"manifest/vector length mismatch for field '{lane}' in "), F.col("video_id"))
    )
    vec = F.when(F.col("vec").isNull() | F.col("listed").isNull(), mismatch).otherwise(F.col("vec"))
    if dim is not None:
        wrong = F.raise_error(
            F.concat(
                F.lit(f"dim mismatch for field '{lane}': expected dim {dim}, actual "),
                F.size("vec").cast("string"),
            )
        )
        vec = F.when((F.size("vec") != dim) | (F.col("ndim") != 2), wrong).otherwise(vec)
    return joined.select(F.lit(lane).alias("lane"), "video_id", "row", "frame_id", "path", vec.alias("vec"))


def missing_lane_files(spark: SparkSession, index_root: str, lanes: Sequence[str]) -> DataFrame:
    """(lane, video_id, kind): vector and manifest files that a video of the first lane lacks."""
    videos = files(spark, f"{index_root}/{lanes[0]}", "*.npy").select(_stem().alias("video_id")).distinct()
    have = None
    for lane in lanes:
        for kind, pattern in (("vectors", "*.npy"), ("manifest", "*.manifest.jsonl")):
            part = files(spark, f"{index_root}/{lane}", pattern).select(
                _stem().alias("video_id"), F.lit(lane).alias("lane"), F.lit(kind).alias("kind")
            )
            have = part if have is None else have.unionByName(part)
    wanted = videos.select(
        "video_id", F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane")
    ).select("video_id", "lane", F.explode(F.array(F.lit("vectors"), F.lit("manifest"))).alias("kind"))
    return wanted.join(have, ["video_id", "lane", "kind"], "left_anti").select("lane", "video_id", "kind")


def read_index(spark: SparkSession, index_root: str, dims: dict[str, int]) -> DataFrame:
    """All lanes of all videos found under the first lane. A missing sibling file is an error."""
    missing = missing_lane_files(spark, index_root, list(dims)).orderBy("lane", "video_id").limit(1).collect()
    if missing:
        m = missing[0]
        raise FileNotFoundError(f"missing {m['kind']} for field {m['lane']!r}: video {m['video_id']}")
    out = None
    for lane, dim in dims.items():
        part = read_lane(spark, index_root, lane, dim)
        out = part if out is None else out.unionByName(part)
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Scalar metadata by key; of several lines with one key the last counts."""
    lines = spark.read.text(path).select(
        F.from_json("value", KEYFRAME_META).alias("m"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("at"),
        "value",
    )
    m = F.col("m")
    keyed = lines.where(F.trim("value") != "").select(
        metadata_key(m["pk"], m["video_id"], m["frame_id"]).alias("pk"),
        m["youtube_url"].alias("youtube_url"),
        m["description"].alias("description"),
        m["od_tags"].alias("od_tags"),
        "at",
    )
    row = F.max_by(F.struct("youtube_url", "description", "od_tags"), "at").alias("row")
    return keyed.groupBy("pk").agg(row).select("pk", "row.*")


def _row_aligned_ids(spark: SparkSession, root: str, n: int) -> DataFrame | None:
    """(row, key) from the first id list of length ``n``: json, then jsonl, then txt."""
    listing = [r["path"] for r in files(spark, root, "*.{json,jsonl,txt}").orderBy("path").toLocalIterator()]
    for suffix in (".json", ".jsonl", ".txt"):
        for path in (p for p in listing if p.endswith(suffix)):
            if suffix == ".json":
                whole = spark.read.text(path, wholetext=True)
                ids = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("row", "key"))
            else:
                lines = spark.read.text(path).select(
                    F.trim("value").alias("value"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"),
                )
                lines = dense_ordinal(lines.where(F.col("value") != ""), [], ["block", "at"], "row")
                fields = F.from_json("value", "frame_id string, id string")
                key = F.coalesce(fields["frame_id"], fields["id"]) if suffix == ".jsonl" else F.col("value")
                ids = lines.select("row", key.alias("key"))
            if ids.count() == n:
                return ids.select(F.col("row").cast("long").alias("row"), "key")
    return None


def read_features(spark: SparkSession, root: str) -> DataFrame:
    """(key, vec) of a feature store, at unit length. Three layouts are tried in turn:

    one matrix with an id list; a matrix per video, keyed ``<video>_<row + 1>`` with three
    digits at least; a vector per id.
    """
    npy = files(spark, root, "*.npy", recursive=True)
    few = npy.orderBy("path").limit(2).collect()
    if not few:
        raise ValueError(f"no .npy found under {root}")
    matrices = read_matrices(spark, root, recursive=True)
    first_stem = few[0]["path"].rsplit("/", 1)[-1][: -len(".npy")]
    first = matrices.where(F.col("video_id") == first_stem).agg(F.count(F.lit(1)).alias("n"), F.max("ndim").alias("d")).first()
    unit = l2_normalise(F.col("vec")).alias("vec")
    if len(few) == 1:
        ids = _row_aligned_ids(spark, root, first["n"]) if first["d"] == 2 else None
        if ids is None:
            raise ValueError(f"one matrix but no id list of its length under {root}")
        return matrices.join(ids, "row").select("key", unit)
    if first["d"] == 2 and first["n"] >= 2:
        key = F.concat("video_id", F.lit("_"), F.format_string("%03d", F.col("row") + 1))
        return matrices.where(F.col("ndim") == 2).select(key.alias("key"), unit)
    whole = matrices.groupBy("video_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "vec"))), lambda s: s["vec"])).alias("vec")
    )  # one vector per file, however it is shaped
    return whole.select(F.col("video_id").alias("key"), unit)
