"""Relation schemas shared by readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

TASK_TYPES = ("KIS", "QA", "AD_HOC", "TRAKE")
FAILURE_KINDS = ("none", "backend_down", "timeout", "schema_error")
FUSION_MODES = ("single", "rrf")

GROUND_TRUTH = T.StructType(
    [
        T.StructField("kis_frame_ids", T.ArrayType(T.StringType())),
        T.StructField("qa_answer", T.StringType()),
        T.StructField("qa_answer_acceptable", T.ArrayType(T.StringType())),
        T.StructField("adhoc_frame_ids", T.ArrayType(T.StringType())),
        T.StructField("trake_frame_ids", T.ArrayType(T.StringType())),
    ]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("query_vi", T.StringType()),
        T.StructField("query_en", T.StringType()),
        T.StructField("time_limit_seconds", T.LongType()),
        T.StructField("ground_truth", GROUND_TRUTH),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

SUBMISSIONS = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("frame_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

LANE_VECTORS = T.StructType(
    [
        T.StructField("lane", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("frame_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("vec", VECTOR),
    ]
)

KEYFRAME_META = T.StructType(
    [
        T.StructField("pk", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("frame_id", T.StringType()),
        T.StructField("youtube_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("od_tags", T.ArrayType(T.StringType())),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("blobs", T.ArrayType(T.StringType())),
        T.StructField("env", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Declared width of each dense lane, and string length limits of the collection.
LANE_DIMS = {"siglip2": 1152, "metaclip2": 1024, "qwen3vl": 2048}
STRING_LIMITS = {
    "pk": 384,
    "video_id": 64,
    "frame_id": 256,
    "youtube_url": 512,
    "description": 8192,
    "od_tag": 128,
}
MAX_OD_TAGS = 128
