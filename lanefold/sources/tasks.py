"""Evaluation tasks from JSON lines, strictly validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.json_leaves import is_json
from lanefold.operators.sizing import dense_ordinal
from lanefold.schemas import GROUND_TRUTH, TASK_TYPES, TASKS


class TaskLoadError(ValueError):
    """A task file cannot be used; the message names file and line."""


def _first(checks: list[tuple[Column, Column | str]]) -> Column:
    out = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        text = F.lit(message) if isinstance(message, str) else message
        out = F.when(failed, text).otherwise(out)
    return out


def _complaint(raw: Column, t: Column) -> Column:
    """What is wrong with a line, or NULL."""
    known = F.array(*[F.lit(f.name) for f in TASKS])
    inner = F.array(*[F.lit(f.name) for f in GROUND_TRUTH])
    extra = F.array_except(F.json_object_keys(raw), known)
    gt_json = F.get_json_object(raw, "$.ground_truth")
    gt_extra = F.array_except(F.json_object_keys(gt_json), inner)
    gt, kind = t["ground_truth"], t["task_type"]

    def lacks(name: str) -> Column:
        return F.coalesce(F.size(gt[name]), F.lit(0)) < 1

    def needs(task_type: str, name: str) -> str:
        return f"ground_truth.{name}: missing or empty, a {task_type} task cannot do without"

    checks: list[tuple[Column, Column | str]] = [
        (~is_json(raw) | t.isNull(), "invalid JSON"),
        (F.json_object_keys(raw).isNull(), "expected an object"),
        (F.size(extra) > 0, F.concat(F.get(extra, F.lit(0)), F.lit(": unknown field"))),
    ]
    for name in ("task_id", "task_type", "query_vi"):
        checks.append((t[name].isNull(), f"{name}: field required"))
    checks += [
        (~kind.isin(*TASK_TYPES), f"task_type: must be one of {', '.join(TASK_TYPES)}"),
        (t["time_limit_seconds"].isNull(), "time_limit_seconds: integer required"),
        (t["time_limit_seconds"] <= 0, "time_limit_seconds: must be greater than 0"),
        (gt.isNull() | gt_json.isNull(), "ground_truth: field required"),
        (F.size(gt_extra) > 0, F.concat(F.lit("ground_truth."), F.get(gt_extra, F.lit(0)), F.lit(": unknown field"))),
        ((kind == "KIS") & lacks("kis_frame_ids"), needs("KIS", "kis_frame_ids")),
        ((kind == "QA") & (F.coalesce(gt["qa_answer"], F.lit("")) == ""), needs("QA", "qa_answer")),
        ((kind == "AD_HOC") & lacks("adhoc_frame_ids"), needs("AD_HOC", "adhoc_frame_ids")),
        ((kind == "TRAKE") & lacks("trake_frame_ids"), needs("TRAKE", "trake_frame_ids")),
        (
            (kind == "TRAKE") & (F.size(gt["trake_frame_ids"]) != 4),
            "ground_truth.trake_frame_ids: a TRAKE task lists four",
        ),
    ]
    return _first(checks)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a ``.jsonl`` file or of the ``.jsonl`` files of a folder, by task id.

    The first line that is no task is an error. Lines are numbered only when there is one.
    """
    reader = spark.read
    if not path.endswith(".jsonl"):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    filled = lines.where(F.trim("value") != "")
    parsed = filled.withColumn("task", F.from_json("value", TASKS))
    judged = parsed.withColumn("complaint", _complaint(F.col("value"), F.col("task")))
    bad = judged.where(F.col("complaint").isNotNull()).select("file", "block", "at", "complaint")
    first = bad.orderBy("file", "block", "at").limit(1).collect()
    if first:
        numbered = dense_ordinal(lines.select("file", "block", "at"), ["file"], ["block", "at"], "line")
        row = numbered.where(
            (F.col("file") == first[0]["file"]) & (F.col("block") == first[0]["block"]) & (F.col("at") == first[0]["at"])
        ).first()
        raise TaskLoadError(f"{first[0]['file']}:{row['line'] + 1}: {first[0]['complaint']}")
    tasks = judged.select("task.*")
    if tasks.isEmpty():
        raise TaskLoadError(f"no tasks found in {path}")
    gt = F.col("ground_truth")
    return (
        tasks.withColumn("qa_answer", gt["qa_answer"])
        .withColumn("qa_acceptable", F.coalesce(gt["qa_answer_acceptable"], F.array().cast("array<string>")))
        .orderBy("task_id")
    )
