"""Building and reading the keyframe collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanefold.functions.identifiers import blank_to_null, compose_pk, full_url
from lanefold.functions.vectors import checked_width
from lanefold.operators.sizing import dense_ordinal
from lanefold.schemas import MAX_OD_TAGS, STRING_LIMITS

STRETCH = 4096  # frames of one video brought together when looking for neighbours


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the highest ``order``: last write wins, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(
        *keys, "_row.*"
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``current`` with rows of ``incoming`` put in place of those with the same key."""
    newest = latest(incoming, keys, order)
    kept = current.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest)


def lane_presence(vectors: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """Per frame and lane: the vector of the last row, and the first lane's row number."""
    vectors = vectors.where(F.col("lane").isin(list(lanes)))
    picks = []
    for i, lane in enumerate(lanes):
        mine = F.col("lane") == lane
        picks.append(F.max_by(F.when(mine, F.col("vec")), F.when(mine, F.col("row"))).alias(lane))
        if i == 0:  # of a repeated id the last row counts, in place as in vector
            picks.append(F.max(F.when(mine, F.col("row"))).alias("frame_idx"))
    return vectors.groupBy("video_id", "frame_id").agg(*picks)


def number_rows(
    vectors: DataFrame, order: Sequence[str]
) -> DataFrame:
    """``row``: 0-based place of each vector within its lane and video."""
    return dense_ordinal(vectors, ["lane", "video_id"], order, "row")


def align_lanes(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """One row per frame with a vector column per lane, its key and its 0-based place in the video.

    ``vectors`` is (lane, video_id, row, frame_id, vec), ``row`` being the 0-based place in
    its manifest. A frame that a lane lacks, or a vector of the wrong width, is an error.
    Lanes are declared by ``dims``; the first one sets the order.
    """
    lanes = list(dims)
    wide = lane_presence(vectors, lanes)
    guarded = []
    for lane in lanes:
        message = F.concat(
            F.lit(f"frame_id set mismatch: lane '{lane}' lacks frame "),
            compose_pk(F.col("video_id"), F.col("frame_id")),
        )
        present = F.when(F.col(lane).isNull(), F.raise_error(message)).otherwise(F.col(lane))
        guarded.append(checked_width(present, dims[lane], lane).alias(lane))
    return wide.select(
        compose_pk(F.col("video_id"), F.col("frame_id")).alias("pk"),
        "video_id",
        "frame_id",
        "frame_idx",
        *guarded,
    )


def lane_coverage(vectors: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """Per video: frames seen, frames in each lane, and whether all lanes cover the same ones."""
    wide = lane_presence(vectors, lanes)
    counts = [F.count(lane).alias(f"n_{lane}") for lane in lanes]
    missing = F.array_compact(
        F.array(*[F.when(F.col(f"n_{lane}") < F.col("n_frames"), F.lit(lane)) for lane in lanes])
    )
    return (
        wide.groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("n_frames"), *counts)
        .withColumn("incomplete_lanes", F.array_join(missing, ","))
        .withColumn("aligned", F.size(missing) == 0)
    )


def metadata_key(pk: Column, video_id: Column, frame_id: Column) -> Column:
    """Key of a metadata row: pk, else video and frame, else the bare frame id."""
    return F.coalesce(pk, compose_pk(video_id, frame_id), frame_id)


def enrich(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Scalar metadata by pk, with defaults where there is none."""
    meta = meta.select("pk", "youtube_url", "description", "od_tags")
    return (
        frames.join(meta, "pk", "left")
        .withColumn("youtube_url", F.coalesce("youtube_url", F.lit("")))
        .withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("od_tags", F.coalesce("od_tags", F.array().cast("array<string>")))
    )


def checked_strings(frames: DataFrame) -> DataFrame:
    """The same frames; an error where a string or tag list exceeds its declared limit."""
    for name, limit in STRING_LIMITS.items():
        if name in frames.columns:
            ok = F.octet_length(name) <= limit
            text = F.raise_error(F.lit(f"{name} exceeds {limit} bytes"))
            frames = frames.withColumn(name, F.when(ok | F.col(name).isNull(), F.col(name)).otherwise(text))
    if "od_tags" in frames.columns:
        tags = F.col("od_tags")
        ok = (F.size(tags) <= MAX_OD_TAGS) & ~F.exists(
            tags, lambda t: F.octet_length(t) > STRING_LIMITS["od_tag"]
        )
        frames = frames.withColumn(
            "od_tags", F.when(ok, tags).otherwise(F.raise_error(F.lit("od_tags exceeds its limits")))
        )
    return frames


def neighbours(frames: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(pk, neighbours): keys of the frames just before and after in the same video, in order.

    A gap in ``frame_idx`` gives no neighbour. Videos are cut into stretches of ``stretch``
    numbers, whose end frames also go to the stretch beside theirs: one shuffle, and no
    group larger than a stretch however long the video is.
    """
    idx, n = F.col("frame_idx"), F.lit(stretch)
    home = F.floor(idx / n)
    beside = F.when(idx % n == 0, home - 1), F.when(idx % n == n - 1, home + 1)
    placed = frames.select(
        "pk", "video_id", "frame_idx", home.alias("_home"), F.explode(F.array_compact(F.array(home, *beside))).alias("_stretch")
    )
    along = Window.partitionBy("video_id", "_stretch").orderBy("frame_idx")

    def near(step: int) -> Column:
        return F.when(F.lag("frame_idx", step).over(along) == idx - step, F.lag("pk", step).over(along))

    found = placed.select("pk", "_home", "_stretch", F.array_compact(F.array(near(1), near(-1))).alias("neighbours"))
    return found.where(F.col("_home") == F.col("_stretch")).select("pk", "neighbours")


def frame_detail(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """Scalar payload of the asked keys; a key that is not there gives no row."""
    return frames.join(keys.select("pk").distinct(), "pk", "left_semi").select(
        "pk",
        "video_id",
        "frame_id",
        "frame_idx",
        blank_to_null(F.col("youtube_url")).alias("youtube_url"),
        blank_to_null(F.col("description")).alias("description"),
        F.coalesce("od_tags", F.array().cast("array<string>")).alias("od_tags"),
        F.lit(None).cast("string").alias("ocr_text"),
        F.lit(None).cast("string").alias("asr_text"),
        full_url(F.col("video_id"), F.col("frame_id")).alias("full_url"),
    )


def lookup_features(frames: DataFrame, features: DataFrame, dim: int, strict: bool = True) -> DataFrame:
    """Feature vector of each frame key; a missing one is an error, or zero when not strict."""
    joined = frames.join(features.select("key", "vec"), "key", "left")
    absent = (
        F.raise_error(F.concat(F.lit("no feature for key "), F.col("key")))
        if strict
        else F.array_repeat(F.lit(0.0).cast("float"), dim)
    )
    return joined.withColumn("found", F.col("vec").isNotNull()).withColumn(
        "vec", F.when(F.col("vec").isNull(), absent).otherwise(F.col("vec"))
    )
