"""Evaluation of ranked answers.

Tasks come from the event stream: each user is asked three times. A user's answers are
their events, highest value first. Correct answers are purchases (KIS), clicks (AD_HOC)
and the four highest events other than errors, in order (TRAKE). QA tasks come from the
conversations: the first reply is the answer, words of the first request are the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanefold.functions.scoring import adhoc_score, kis_score, qa_correct
from lanefold.operators import evaluation as E, percentiles as P, stub
from lanefold.operators.sizing import dense_ordinal
from lanefold.plans.inputs import table
from lanefold.plans.noise_queries import uniform_sql
from lanefold.plans.registry import query

STUB_ANSWERS = 20  # what a task file of the stub lists
LIMITS = {"KIS": 300, "AD_HOC": 180, "TRAKE": 180, "QA": 180}


def _limit() -> Column:
    return F.when(F.col("task_type") == "KIS", LIMITS["KIS"]).otherwise(LIMITS["QA"]).cast("long")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def _best(events: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return events.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def _per_type(df: DataFrame, types) -> DataFrame:
    return df.withColumn("task_type", F.explode(F.array(*[F.lit(t) for t in types]))).withColumn(
        "task_id", F.concat("task_type", F.lit("-"), "user_id")
    )


def frame_tasks(spark: SparkSession, sf: str) -> DataFrame:
    users = _events(spark, sf).groupBy("user_id").agg((F.avg("value") * 10000).alias("elapsed_ms"))
    return _per_type(users, ("KIS", "AD_HOC", "TRAKE")).select(
        "task_id",
        "task_type",
        _limit().alias("time_limit_seconds"),
        "elapsed_ms",
        F.lit(None).cast("string").alias("qa_answer"),
        F.lit(None).cast("array<string>").alias("qa_acceptable"),
    )


def frame_submissions(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf).withColumn("below", -F.col("value"))
    ranked = dense_ordinal(events, ["user_id"], ["below", "event_id"], "rank").withColumn("rank", F.col("rank") + 1)
    return _per_type(ranked.drop("below"), ("KIS", "AD_HOC", "TRAKE")).select(
        "task_id",
        "rank",
        F.col("value").alias("score"),
        F.col("event_id").cast("string").alias("frame_id"),
        F.lit(None).cast("string").alias("text"),
    )


def frame_truth(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    any_order = events.where(F.col("event_type").isin("purchase", "click")).select(
        F.concat(F.when(F.col("event_type") == "purchase", "KIS-").otherwise("AD_HOC-"), "user_id").alias("task_id"),
        F.col("event_id").cast("string").alias("frame_id"),
        F.lit(None).cast("long").alias("ord"),
    )
    ordered = _best(events.where(F.col("event_type") != "error"), 4).select(
        F.concat(F.lit("TRAKE-"), "user_id").alias("task_id"),
        F.col("event_id").cast("string").alias("frame_id"),
        F.col("rank").alias("ord"),
    )
    return any_order.unionByName(ordered)


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    per = turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"),
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("request"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    words = F.split(F.col("request"), " ")
    return per.select(
        F.concat(F.lit("QA-"), "conv_id").alias("task_id"),
        F.lit("QA").alias("task_type"),
        F.lit(LIMITS["QA"]).cast("long").alias("time_limit_seconds"),
        (F.col("n_turns") * 12500.0).alias("elapsed_ms"),
        F.get(words, F.lit(0)).alias("qa_answer"),
        F.array_compact(F.array(F.get(words, F.lit(5)), F.get(words, F.lit(6)))).alias("qa_acceptable"),
        "reply",
    )


def all_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return frame_tasks(spark, sf).unionByName(_qa(spark, sf).drop("reply"))


def all_submissions(spark: SparkSession, sf: str) -> DataFrame:
    qa = _qa(spark, sf).where(F.col("reply").isNotNull()).select(
        "task_id",
        F.lit(1).cast("long").alias("rank"),
        F.lit(1.0).alias("score"),
        F.lit(None).cast("string").alias("frame_id"),
        F.col("reply").alias("text"),
    )
    return frame_submissions(spark, sf).unionByName(qa)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.ranking_metrics(frame_submissions(spark, sf), frame_truth(spark, sf))


_BASE = f"""WITH best AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
  calm AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS ord
    FROM events WHERE event_type <> 'error'),
  kinds AS (SELECT unnest(['KIS', 'AD_HOC', 'TRAKE']) AS task_type),
  tasks AS (SELECT task_type || '-' || user_id AS task_id, task_type, CASE WHEN task_type = 'KIS' THEN 300 ELSE 180 END AS lim,
      elapsed_ms FROM (SELECT user_id, avg(value) * 10000 AS elapsed_ms FROM events GROUP BY user_id), kinds),
  subs AS (SELECT task_type || '-' || user_id AS task_id, rank, event_id FROM best, kinds),
  truth AS (SELECT CASE event_type WHEN 'purchase' THEN 'KIS-' ELSE 'AD_HOC-' END || user_id AS task_id, event_id, NULL AS ord
      FROM events WHERE event_type IN ('purchase', 'click')
    UNION ALL SELECT 'TRAKE-' || user_id, event_id, ord FROM calm WHERE ord <= 4),
  judged AS (SELECT subs.*, truth.event_id IS NOT NULL AS rel, truth.ord FROM subs LEFT JOIN truth USING (task_id, event_id)),
  sizes AS (SELECT task_id, count(*) AS n_relevant FROM truth GROUP BY task_id),
  per AS (SELECT task_id, coalesce(max(CASE WHEN rel AND rank <= 1 THEN 1.0 END), 0)::DOUBLE AS r1,
      coalesce(max(CASE WHEN rel AND rank <= 5 THEN 1.0 END), 0)::DOUBLE AS r5,
      coalesce(max(CASE WHEN rel AND rank <= 10 THEN 1.0 END), 0)::DOUBLE AS r10,
      coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0) AS mrr, min(rank) FILTER (rel) AS first_rank, count(*) AS n_subs,
      count(*) FILTER (rel AND rank <= 10) AS hits, count(*) FILTER (NOT rel AND rank <= 10) AS misses,
      coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS dcg,
      count(*) FILTER (ord = rank AND rank <= 4) AS in_seq FROM judged GROUP BY task_id),
  m AS (SELECT t.task_id, t.task_type, t.lim, t.elapsed_ms, coalesce(r1, 0) AS r1, coalesce(r5, 0) AS r5, coalesce(r10, 0) AS r10,
      coalesce(mrr, 0) AS mrr, first_rank, coalesce(n_subs, 0) AS n_subs, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses,
      coalesce(n_relevant, 0) AS n_relevant, coalesce(in_seq, 0) AS in_seq,
      coalesce(hits / n_relevant, 0) AS recall,
      coalesce(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n_relevant), 0) AS ndcg
    FROM tasks t LEFT JOIN per USING (task_id) LEFT JOIN sizes USING (task_id))
"""


@query(
    "recall_at_k",
    _BASE + "SELECT task_id, r1 AS r_at_1, r5 AS r_at_5, r10 AS r_at_10 FROM m",
)
def recall_at_k(spark, sf):
    return _metrics(spark, sf).select("task_id", "r_at_1", "r_at_5", "r_at_10")


@query("mrr", _BASE + "SELECT task_id, round(mrr, 9) AS mrr FROM m")
def mrr(spark, sf):
    return _metrics(spark, sf).select("task_id", F.round("mrr", 9).alias("mrr"))


@query("adhoc_recall", _BASE + "SELECT task_id, hits, n_relevant, round(recall, 9) AS recall FROM m")
def adhoc_recall(spark, sf):
    return _metrics(spark, sf).select(
        "task_id", "hits", "n_relevant", F.round("adhoc_recall", 9).alias("recall")
    )


@query("ndcg_at_10", _BASE + "SELECT task_id, round(ndcg, 6) AS ndcg_at_10 FROM m")
def ndcg_at_10(spark, sf):
    return _metrics(spark, sf).select("task_id", F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


_KIS = """greatest(0, 100 - 50 * least({s} / lim, 1.0) - 10 * {w})"""
_SCORED = _BASE + f""", qa AS (SELECT 'QA-' || conv_id AS task_id, 180 AS lim, n_turns * 12500.0::DOUBLE AS elapsed_ms, reply,
      [lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) for x in [w[1], w[6], w[7]] if x IS NOT NULL] AS targets, w[1] AS canonical,
      lower(trim(regexp_replace(reply, '\\s+', ' ', 'g'))) AS given
    FROM (SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) FILTER (role = 'assistant') AS reply,
            string_split(arg_min(text, turn) FILTER (role = 'user'), ' ') AS w FROM conversations GROUP BY conv_id)),
  qa_ok AS (SELECT *, coalesce(reply <> '' AND canonical <> ''
      AND len([t for t in targets if t <> '' AND (contains(given, t) OR contains(t, given))]) > 0, false) AS ok FROM qa),
  s AS (SELECT task_id, task_type, r1, r5, r10, mrr, ndcg, elapsed_ms, lim,
      CASE task_type WHEN 'KIS' THEN r10 = 1 WHEN 'AD_HOC' THEN hits > 0 ELSE n_relevant = 4 AND in_seq = 4 END AS ok,
      CASE task_type WHEN 'KIS' THEN CASE WHEN r1 = 1 THEN 0 WHEN r10 = 1 THEN first_rank - 1 ELSE n_subs END
        WHEN 'AD_HOC' THEN misses ELSE CASE WHEN n_relevant = 4 AND in_seq = 4 THEN 0 ELSE 1 END END AS wrong,
      hits, misses, n_relevant FROM m
    UNION ALL SELECT task_id, 'QA', ok::INT, ok::INT, ok::INT, ok::INT, ok::INT, elapsed_ms, lim, ok, 1 - ok::INT, 0, 0, 0 FROM qa_ok),
  scored AS (SELECT *,
      CASE WHEN ok AND task_type <> 'AD_HOC' THEN elapsed_ms END AS ttc,
      CASE WHEN task_type = 'AD_HOC' THEN NULL WHEN NOT ok THEN 0.0
        ELSE {_KIS.format(s="(elapsed_ms / 1000)", w="(CASE WHEN task_type = 'KIS' THEN wrong ELSE 0 END)")} END::DOUBLE AS kis,
      CASE WHEN task_type = 'AD_HOC' THEN CASE WHEN hits = 0 THEN 0.0
        ELSE 100.0::DOUBLE * (hits / (hits + misses / 2.0::DOUBLE)) * (hits / greatest(n_relevant, 1)) END END::DOUBLE AS adhoc
    FROM s)
"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_tasks(all_tasks(spark, sf), all_submissions(spark, sf), frame_truth(spark, sf))


@query(
    "task_scores",
    _SCORED
    + """SELECT task_id, task_type, r1::DOUBLE AS r_at_1, r5::DOUBLE AS r_at_5, r10::DOUBLE AS r_at_10, round(mrr::DOUBLE, 6) AS mrr,
        round(ndcg::DOUBLE, 6) AS ndcg_at_10, round(elapsed_ms, 4) AS end_to_end_ms, round(ttc, 4) AS time_to_first_correct_ms,
        wrong::BIGINT AS wrong_submissions, round(kis, 6) AS kis_score,
        CASE WHEN task_type = 'AD_HOC' THEN hits END AS adhoc_correct, CASE WHEN task_type = 'AD_HOC' THEN misses END AS adhoc_incorrect,
        round(adhoc, 6) AS adhoc_score, ok FROM scored""",
)
def task_scores(spark, sf):
    digits = {"mrr": 6, "ndcg_at_10": 6, "end_to_end_ms": 4, "time_to_first_correct_ms": 4, "kis_score": 6, "adhoc_score": 6}
    scores = _scores(spark, sf)
    return scores.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in scores.columns])


@query(
    "score_rollup_by_type",
    _SCORED
    + """, g AS (SELECT coalesce(task_type, 'ALL') AS task_type, count(*) AS n, count(*) FILTER (ok) AS n_correct,
        avg(r1) AS r1, avg(r5) AS r5, avg(r10) AS r10, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(wrong) AS wrong,
        avg(kis) AS kis, avg(adhoc) AS adhoc FROM scored GROUP BY ROLLUP (task_type))
      SELECT d.task_type, coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, round(coalesce(r1, 0), 6) AS mean_r_at_1,
        round(coalesce(r5, 0), 6) AS mean_r_at_5, round(coalesce(r10, 0), 6) AS mean_r_at_10, round(coalesce(mrr, 0), 6) AS mean_mrr,
        round(coalesce(ndcg, 0), 6) AS mean_ndcg_at_10, round(coalesce(wrong, 0), 6) AS wrong_submissions_per_task,
        round(kis, 6) AS mean_kis_score, round(adhoc, 6) AS mean_adhoc_score
      FROM (SELECT unnest(['KIS', 'QA', 'AD_HOC', 'TRAKE', 'ALL']) AS task_type) d LEFT JOIN g USING (task_type)""",
)
def score_rollup_by_type(spark, sf):
    rolled = E.roll_up(_scores(spark, sf))
    exact = ("task_type", "n", "n_correct")
    return rolled.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in rolled.columns])


@query(
    "kis_score",
    """SELECT event_id, round(CASE WHEN event_type = 'error' THEN 0.0
        ELSE greatest(0, 100 - 50 * least(value * 10 / 300, 1.0) - 10 * (event_id % 4)) END::DOUBLE, 6) AS kis_score FROM events""",
)
def kis_score_query(spark, sf):
    """Each event as an answer after ten times its value in seconds; errors never solve the task."""
    seconds = F.when(F.col("event_type") != "error", F.col("value") * 10)
    return _events(spark, sf).select(
        "event_id",
        F.round(kis_score(seconds, F.col("event_id") % 4, F.lit(300)), 6).alias("kis_score"),
    )


@query(
    "adhoc_score",
    """SELECT user_id, c AS correct, i AS incorrect, n AS relevant, round(CASE WHEN c = 0 OR n = 0 THEN 0.0
        ELSE 100.0::DOUBLE * (c / (c + i / 2.0::DOUBLE)) * (c / n) END::DOUBLE, 6) AS adhoc_score
      FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS i,
              count(*) FILTER (event_type IN ('click', 'view')) AS n FROM events GROUP BY user_id)""",
)
def adhoc_score_query(spark, sf):
    kind = F.col("event_type")
    counts = _events(spark, sf).groupBy("user_id").agg(
        F.count_if(kind == "click").alias("correct"),
        F.count_if(kind == "error").alias("incorrect"),
        F.count_if(kind.isin("click", "view")).alias("relevant"),
    )
    score = adhoc_score(F.col("correct"), F.col("incorrect"), F.col("relevant"))
    return counts.select("*", F.round(score, 6).alias("adhoc_score"))


@query("trake_correct", _SCORED + "SELECT task_id, ok FROM scored WHERE task_type = 'TRAKE'")
def trake_correct(spark, sf):
    return _scores(spark, sf).where(F.col("task_type") == "TRAKE").select("task_id", "ok")


@query("qa_correct", _SCORED + "SELECT task_id, canonical, len(targets)::BIGINT AS n_targets, ok FROM qa_ok")
def qa_correct_query(spark, sf):
    return _qa(spark, sf).select(
        "task_id",
        F.col("qa_answer").alias("canonical"),
        (F.size("qa_acceptable") + F.when(F.col("qa_answer").isNotNull(), 1).otherwise(0)).cast("long").alias("n_targets"),
        qa_correct(F.col("reply"), F.col("qa_answer"), F.col("qa_acceptable")).alias("ok"),
    )


def _latency(df: DataFrame) -> DataFrame:
    return df.select("event_type", "n", *[F.round(c, 6).alias(c) for c in df.columns if c.endswith("_ms")])


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
        round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY event_type""",
)
def latency_percentiles(spark, sf):
    return _latency(P.latency_stats(_events(spark, sf), ["event_type"], "value"))


@query(
    "latency_percentiles_overall",
    """SELECT count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
        round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events""",
)
def latency_percentiles_overall(spark, sf):
    stats = P.latency_stats(_events(spark, sf), [], "value")
    return stats.select("n", *[F.round(c, 6).alias(c) for c in stats.columns if c.endswith("_ms")])


_NEAREST = """SELECT event_type, n, round(v[{p50}], 6) AS p50_ms, round(v[{p95}], 6) AS p95_ms
    FROM (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS v FROM events GROUP BY event_type)"""


@query(
    "latency_nearest_rank_b",
    _NEAREST.format(p50="n // 2 + 1", p95="least(n - 1, round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT) + 1"),
)
def latency_nearest_rank_b(spark, sf):
    return _latency(P.upper_median_and_p95(_events(spark, sf), ["event_type"], "value")).drop("mean_ms")


@query(
    "latency_nearest_rank_c",
    _NEAREST.format(p50="(n + 1) // 2", p95="greatest(0, round_even(0.95::DOUBLE * n, 0)::BIGINT - 1) + 1").replace(
        "round(v[(n + 1) // 2], 6)", "round((v[(n + 1) // 2] + v[n // 2 + 1]) / 2, 6)"
    ),
)
def latency_nearest_rank_c(spark, sf):
    return _latency(P.true_median_and_p95(_events(spark, sf), ["event_type"], "value")).drop("mean_ms")


def stub_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks in the task-file shape: per user three frame tasks, per conversation a question."""
    best = _best(_events(spark, sf), STUB_ANSWERS)
    either = best.where(F.col("event_type").isin("purchase", "click")).select(
        F.concat(F.when(F.col("event_type") == "purchase", "KIS-").otherwise("AD_HOC-"), "user_id").alias("task_id"),
        F.col("rank").alias("at"),
        F.col("event_id").cast("string").alias("frame_id"),
    )
    calm = _best(_events(spark, sf).where(F.col("event_type") != "error"), 4).select(
        F.concat(F.lit("TRAKE-"), "user_id").alias("task_id"),
        F.col("rank").alias("at"),
        F.col("event_id").cast("string").alias("frame_id"),
    )
    # twenty ids per task at most, as a task file lists them
    lists = either.unionByName(calm).groupBy("task_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "frame_id"))), lambda s: s["frame_id"]).alias("ids")
    )
    base = all_tasks(spark, sf).join(lists, "task_id", "left")

    def ids(kind: str) -> Column:
        return F.when(F.col("task_type") == kind, F.col("ids"))

    return base.select(
        "task_id",
        "task_type",
        "time_limit_seconds",
        "qa_answer",
        "qa_acceptable",
        F.struct(
            ids("KIS").alias("kis_frame_ids"),
            F.col("qa_answer").alias("qa_answer"),
            F.col("qa_acceptable").alias("qa_answer_acceptable"),
            ids("AD_HOC").alias("adhoc_frame_ids"),
            ids("TRAKE").alias("trake_frame_ids"),
        ).alias("ground_truth"),
    )


def _u(stream: int, i: str = "0::BIGINT") -> str:
    return uniform_sql("h", stream, i)


_STUB_SQL = f"""WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= {STUB_ANSWERS}),
    calm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r <= 4),
    pools AS (SELECT CASE event_type WHEN 'purchase' THEN 'KIS-' ELSE 'AD_HOC-' END || user_id AS task_id, list(event_id::VARCHAR ORDER BY r) AS pool
        FROM best WHERE event_type IN ('purchase', 'click') GROUP BY 1
      UNION ALL SELECT 'TRAKE-' || user_id, list(event_id::VARCHAR ORDER BY r) FROM calm GROUP BY 1),
    t AS (SELECT kind || '-' || user_id AS task_id, kind, NULL::VARCHAR AS qa
        FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['KIS', 'AD_HOC', 'TRAKE']) AS kind)
      UNION ALL SELECT 'QA-' || conv_id, 'QA', (string_split(arg_min(text, turn) FILTER (role = 'user'), ' '))[1] FROM conversations GROUP BY conv_id),
    head AS (SELECT t.*, coalesce(pool, []::VARCHAR[]) AS pool, ('0x' || substr(md5(task_id || '|0'), 1, 7))::BIGINT AS h,
        ('0x' || substr(sha256(task_id), 1, 8))::BIGINT % 10 + 1 AS show_at FROM t LEFT JOIN pools USING (task_id)),
    more AS (SELECT *, {_u(1)} < 0.7 AND (len(pool) > 0 OR kind = 'QA') AS shown, greatest(len(pool), 1) AS size FROM head),
    rows AS (SELECT *, unnest(range(1, CASE WHEN kind = 'QA' THEN 2 ELSE 11 END)) AS rank FROM more),
    full_rows AS (SELECT *, shown AND len(pool) = 4 AS whole, rank <= len(pool) AS inside,
        printf('vid_%03d_f%07d_salt%d', floor({_u(4, 'rank')} * 1000)::BIGINT, floor({_u(5, 'rank')} * 10000)::BIGINT, rank) AS fake FROM rows)
    SELECT task_id, rank, CASE WHEN kind = 'QA' THEN 1.0 ELSE round(greatest(0, 1 - (rank - 1) * CASE WHEN kind = 'TRAKE' AND whole AND inside
        THEN 0.05::DOUBLE ELSE 0.07::DOUBLE END), 6) END::DOUBLE AS score,
      CASE kind WHEN 'QA' THEN NULL WHEN 'TRAKE' THEN CASE WHEN whole AND inside THEN pool[rank]
          WHEN NOT whole AND inside AND {_u(8, 'rank')} < 0.3 THEN pool[(rank - 1 + floor({_u(7)} * size)::BIGINT) % size + 1] ELSE fake END
        ELSE CASE WHEN shown AND (rank = show_at OR (kind = 'AD_HOC' AND rank IN (6, 7) AND {_u(6, 'rank')} < 0.5))
          THEN pool[floor({_u(3, 'rank')} * size)::BIGINT + 1] ELSE fake END END AS frame_id,
      CASE WHEN kind = 'QA' THEN CASE WHEN shown AND coalesce(qa, '') <> '' THEN qa ELSE 'khong biet' END END AS text,
      round(10 + {_u(2)} * 20, 6) AS elapsed_ms FROM full_rows"""


@query("stub_backend_answers", _STUB_SQL)
def stub_backend_answers(spark, sf):
    answers = stub.answer(stub_tasks(spark, sf))
    return answers.withColumn("score", F.round("score", 6)).withColumn("elapsed_ms", F.round("elapsed_ms", 6))


@query("stub_backend_eval")
def stub_backend_eval(spark, sf):
    """Generate answers for every task, score and roll up."""
    tasks = stub_tasks(spark, sf)
    answers = stub.answer(tasks)
    timed = tasks.join(answers.groupBy("task_id").agg(F.max("elapsed_ms").alias("elapsed_ms")), "task_id", "left")
    return E.roll_up(E.score_tasks(timed, answers.drop("elapsed_ms"), E.truth_of(tasks)))
