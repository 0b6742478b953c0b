"""Ranking metrics and task scores of submitted answers.

Relations: submissions (task_id, rank, score, frame_id, text); truth (task_id, frame_id,
ord), one row per correct id. ``rank`` is what the submitter stated; ``position`` is the
place in the list. Recall and NDCG go by position, MRR and wrong answers by rank.

Relevance is an equi-join on (task, frame), so a task with any share of the rows spreads
out; only the first ten positions of a task are ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanefold.functions.scoring import adhoc_score, gain, ideal_gain, kis_score, qa_correct
from lanefold.operators.percentiles import latency_stats
from lanefold.schemas import TASK_TYPES

DEPTH = 10
SEQUENCE_LENGTH = 4


def truth_of(tasks: DataFrame) -> DataFrame:
    """(task_id, frame_id, ord) of the ground truth that the task's type selects; none for QA."""
    gt = F.col("ground_truth")
    ids = (
        F.when(F.col("task_type") == "KIS", gt["kis_frame_ids"])
        .when(F.col("task_type") == "AD_HOC", gt["adhoc_frame_ids"])
        .when(F.col("task_type") == "TRAKE", gt["trake_frame_ids"])
    )
    return tasks.select("task_id", F.posexplode(ids).alias("ord", "frame_id")).select(
        "task_id", "frame_id", (F.col("ord") + 1).cast("long").alias("ord")
    )


def _truth_set(truth: DataFrame) -> DataFrame:
    """Distinct ids per task, with the places 1..4 each id takes as bits."""
    bit = F.when(
        F.col("ord").between(1, SEQUENCE_LENGTH),
        F.element_at(F.array(*[F.lit(1 << i) for i in range(SEQUENCE_LENGTH)]), F.col("ord").cast("int")),
    ).otherwise(0)
    return truth.groupBy("task_id", "frame_id").agg(
        F.bit_or(bit).alias("places"), F.count(F.lit(1)).alias("listed")
    )


def with_relevance(submissions: DataFrame, truth: DataFrame) -> DataFrame:
    """Submissions with ``relevant`` and the truth's ``places``."""
    return submissions.join(_truth_set(truth), ["task_id", "frame_id"], "left").withColumn(
        "relevant", F.col("listed").isNotNull()
    )


def positions(submissions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The first ``depth`` submissions of each task, with their 1-based ``position``."""
    order = Window.partitionBy("task_id").orderBy("rank")
    return submissions.withColumn("position", F.row_number().over(order).cast("long")).where(
        F.col("position") <= depth
    )


def truth_sizes(truth: DataFrame) -> DataFrame:
    """Per task: number of distinct correct ids, of listed ones, and the places 1..4 taken, as bits.

    Built on the same aggregate as the relevance join, whose shuffle Spark then reuses.
    """
    return _truth_set(truth).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_relevant"),
        F.sum("listed").alias("n_listed"),
        F.bit_or("places").alias("places_taken"),
    )


def ranking_metrics(submissions: DataFrame, truth: DataFrame, k: int = DEPTH) -> DataFrame:
    """Per task with any truth: r_at_1, r_at_5, r_at_10 (or k), mrr, recall (fraction), ndcg."""
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    judged = with_relevance(submissions, truth)
    whole = judged.groupBy("task_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"),
        F.count(F.lit(1)).alias("n_submissions"),
    )
    hit = F.col("relevant")

    def within(n: int) -> Column:
        return F.coalesce(F.max(F.when(hit & (F.col("position") <= n), 1.0)), F.lit(0.0))

    top = (
        positions(judged, k)
        .groupBy("task_id")
        .agg(
            within(1).alias("r_at_1"),
            within(min(5, k)).alias("r_at_5"),
            within(k).alias("r_at_10"),
            F.count_if(hit).alias("hits"),
            F.count_if(F.col("frame_id").isNotNull() & (F.col("frame_id") != "") & ~hit).alias("misses"),
            F.sum(F.when(hit, gain(F.col("position"))).otherwise(0.0)).alias("dcg"),
            F.count_if(
                hit
                & (F.col("position") <= SEQUENCE_LENGTH)
                & (F.coalesce("places", F.lit(0)).bitwiseAND(
                    F.element_at(
                        F.array(*[F.lit(1 << i) for i in range(SEQUENCE_LENGTH)]),
                        F.least(F.col("position"), F.lit(SEQUENCE_LENGTH)).cast("int"),
                    )
                ) != 0)
            ).alias("in_sequence"),
            F.max(F.when(F.col("position") == 1, F.col("text"))).alias("first_text"),
        )
    )
    joined = whole.join(top, "task_id").join(truth_sizes(truth), "task_id", "full")
    zero = {"r_at_1": 0.0, "r_at_5": 0.0, "r_at_10": 0.0, "dcg": 0.0}
    zero |= dict.fromkeys(("hits", "misses", "in_sequence", "n_submissions", "n_relevant", "n_listed", "places_taken"), 0)
    joined = joined.withColumns({name: F.coalesce(name, F.lit(v)) for name, v in zero.items()})
    return joined.select(
        "*",
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("adhoc_recall"),
        F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal_gain(F.col("n_relevant"), k)).otherwise(0.0).alias("ndcg_at_10"),
    )


def score_tasks(tasks: DataFrame, submissions: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Every metric of every task.

    ``tasks`` holds (task_id, task_type, time_limit_seconds, elapsed_ms, qa_answer,
    qa_acceptable). A task without submissions is scored as unsolved.
    """
    if truth is None:
        truth = truth_of(tasks)
    metrics = ranking_metrics(submissions, truth)
    t = tasks.join(metrics, "task_id", "left")
    kind, solved_ms = F.col("task_type"), F.col("elapsed_ms")
    n_subs = F.coalesce("n_submissions", F.lit(0))
    zero = F.lit(0.0)
    is_qa = kind == "QA"
    qa_ok = qa_correct(F.col("first_text"), F.col("qa_answer"), F.col("qa_acceptable"))
    qa_value = F.when(qa_ok, 1.0).otherwise(0.0)
    sequence_ok = (
        (F.col("n_listed") == SEQUENCE_LENGTH)
        & (F.col("places_taken") == (1 << SEQUENCE_LENGTH) - 1)
        & (F.col("in_sequence") == SEQUENCE_LENGTH)
    )

    def metric(name: str) -> Column:
        return F.when(is_qa, qa_value).otherwise(F.coalesce(name, zero)).alias(name)

    kis_ok = F.coalesce("r_at_10", zero) == 1.0
    ok = (
        F.when(kind == "KIS", kis_ok)
        .when(kind == "AD_HOC", F.coalesce("hits", F.lit(0)) > 0)
        .when(kind == "TRAKE", F.coalesce(sequence_ok, F.lit(False)))
        .otherwise(qa_ok)
    )
    wrong = (
        F.when(
            kind == "KIS",
            F.when(F.col("r_at_1") == 1.0, 0).when(kis_ok, F.col("first_rank") - 1).otherwise(n_subs),
        )
        .when(kind == "AD_HOC", F.coalesce("misses", F.lit(0)))
        .otherwise(F.when(F.col("ok"), 0).otherwise(1))
        .cast("long")
    )
    timed = F.when(F.col("ok") & (kind != "AD_HOC"), solved_ms)
    base = t.withColumn("ok", ok)
    adhoc = kind == "AD_HOC"
    return base.withColumn("wrong_submissions", wrong).select(
        "task_id",
        "task_type",
        *[metric(n) for n in ("r_at_1", "r_at_5", "r_at_10", "mrr", "ndcg_at_10")],
        F.col("elapsed_ms").alias("end_to_end_ms"),
        timed.alias("time_to_first_correct_ms"),
        "wrong_submissions",
        F.when(
            ~adhoc,
            kis_score(
                timed / 1000.0,
                F.when(kind == "KIS", F.col("wrong_submissions")).otherwise(F.lit(0)),
                F.col("time_limit_seconds"),
            ),
        ).alias("kis_score"),
        F.when(adhoc, F.coalesce("hits", F.lit(0))).alias("adhoc_correct"),
        F.when(adhoc, F.coalesce("misses", F.lit(0))).alias("adhoc_incorrect"),
        F.when(
            adhoc,
            adhoc_score(
                F.coalesce("hits", F.lit(0)),
                F.coalesce("misses", F.lit(0)),
                F.greatest(F.coalesce("n_relevant", F.lit(0)), F.lit(1)),
            ),
        ).alias("adhoc_score"),
        "ok",
    )


def roll_up(scores: DataFrame) -> DataFrame:
    """One row per task type, also for types without tasks, and one for all tasks (``ALL``)."""
    names = ("r_at_1", "r_at_5", "r_at_10", "mrr", "ndcg_at_10")
    grouped = scores.rollup("task_type").agg(
        F.grouping("task_type").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("n_correct"),
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        F.avg("kis_score").alias("mean_kis_score"),
        F.avg("adhoc_score").alias("mean_adhoc_score"),
        F.avg("wrong_submissions").alias("wrong_submissions_per_task"),
    )
    grouped = grouped.withColumn(
        "task_type", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("task_type"))
    ).drop("_all")
    domain = scores.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in (*TASK_TYPES, "ALL")])).alias("task_type")
    )
    filled = domain.join(grouped, "task_type", "left")
    zeros = ["n", "n_correct", *[f"mean_{n}" for n in names], "wrong_submissions_per_task"]
    return filled.select(
        "task_type",
        *[F.coalesce(z, F.lit(0)).alias(z) for z in zeros],
        "mean_kis_score",
        "mean_adhoc_score",
    )


def latency(scores: DataFrame) -> DataFrame:
    return latency_stats(scores, [], "end_to_end_ms")
