"""Metrics and task scores against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lanefold.functions.scoring import adhoc_score, ideal_gain, kis_score, qa_correct
from lanefold.operators import evaluation as E

SUBS = "task_id string, rank long, score double, frame_id string, text string"
TRUTH = "task_id string, frame_id string, ord long"


def ranked(spark, ids, task="t"):
    rows = [(task, i + 1, 1.0 - i / 100, f, None) for i, f in enumerate(ids)]
    return spark.createDataFrame(rows, SUBS)


def truth(spark, ids, task="t"):
    return spark.createDataFrame([(task, f, i + 1) for i, f in enumerate(ids)], TRUTH)


def metrics(spark, ids, correct, k=10):
    return E.ranking_metrics(ranked(spark, ids), truth(spark, correct), k).first()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_recall_and_mrr(spark):
    assert metrics(spark, "abc", "a")["r_at_1"] == 1.0
    m = metrics(spark, "xyaz", "a")
    assert (m["r_at_1"], m["r_at_5"], m["r_at_10"]) == (0.0, 1.0, 1.0)
    assert m["mrr"] == pytest.approx(1 / 3)
    assert metrics(spark, "xyz", "a")["mrr"] == 0.0


def test_fractional_recall_counts_duplicates(spark):
    assert metrics(spark, "axcyz", "abcd", 5)["adhoc_recall"] == 0.5
    assert metrics(spark, "aa", "ab", 5)["adhoc_recall"] == 1.0


def test_ndcg(spark):
    assert metrics(spark, "abc", "abc")["ndcg_at_10"] == pytest.approx(1.0)
    assert metrics(spark, "xya", "a")["ndcg_at_10"] == pytest.approx(0.5)
    idcg4 = sum(1 / math.log2(i + 1) for i in range(1, 5))
    assert metrics(spark, "axb", "abcd")["ndcg_at_10"] == pytest.approx(1.5 / idcg4)
    assert metrics(spark, "x" * 10 + "a", "a")["ndcg_at_10"] == 0.0
    with pytest.raises(ValueError):
        metrics(spark, "a", "a", 0)


def test_mrr_goes_by_rank_and_recall_by_position(spark):
    subs = spark.createDataFrame([("t", 3, 1.0, "a", None), ("t", 9, 0.9, "b", None)], SUBS)
    m = E.ranking_metrics(subs, truth(spark, "a")).first()
    assert m["r_at_1"] == 1.0 and m["mrr"] == pytest.approx(1 / 3)


def test_repeated_truth_is_a_set(spark):
    m = metrics(spark, "ab", "aab")
    assert m["n_relevant"] == 2 and m["hits"] == 2


@pytest.mark.parametrize(
    "seconds, wrong, limit, expected",
    [(0.0, 0, 300, 100.0), (300.0, 0, 300, 50.0), (600.0, 0, 300, 50.0), (300.0, 9, 300, 0.0), (None, 3, 300, 0.0)],
)
def test_kis_score(spark, seconds, wrong, limit, expected):
    got = value(spark, kis_score(F.lit(seconds).cast("double"), F.lit(wrong), F.lit(limit)))
    assert got == pytest.approx(expected)


def test_kis_score_rejects_bad_limits(spark):
    with pytest.raises(Exception, match="positive"):
        value(spark, kis_score(F.lit(1.0), F.lit(0), F.lit(0)))


@pytest.mark.parametrize(
    "c, i, n, expected", [(10, 0, 10, 100.0), (5, 0, 10, 50.0), (5, 4, 10, 100 * 5 / 7 * 0.5), (0, 3, 10, 0.0), (3, 0, 0, 0.0)]
)
def test_adhoc_score(spark, c, i, n, expected):
    assert value(spark, adhoc_score(F.lit(c), F.lit(i), F.lit(n))) == pytest.approx(expected)


@pytest.mark.parametrize(
    "answer, canonical, others, expected",
    [
        ("Hồ Chí  Minh city", "hồ chí minh", [], True),
        ("minh", "hồ chí minh", [], True),
        ("SG", "hồ chí minh", ["sg", " "], True),
        ("hanoi", "hồ chí minh", [], False),
        ("", "x", [], False),
        ("x", "", ["x"], False),
        (None, "x", [], False),
        ("   ", "anything", [], True),  # blank is not empty, and every target contains nothing
    ],
)
def test_qa_correct(spark, answer, canonical, others, expected):
    df = spark.createDataFrame([(answer, canonical, others)], "a string, c string, o array<string>")
    assert df.select(qa_correct(F.col("a"), F.col("c"), F.col("o")).alias("v")).first()["v"] is expected


def test_ideal_gain(spark):
    assert value(spark, ideal_gain(F.lit(0), 10)) == 0.0
    assert value(spark, ideal_gain(F.lit(99), 2)) == pytest.approx(1 + 1 / math.log2(3))


def tasks(spark, *rows):
    return spark.createDataFrame(
        rows, "task_id string, task_type string, time_limit_seconds long, elapsed_ms double, qa_answer string, qa_acceptable array<string>"
    )


def score(spark, kind, ids, correct, elapsed=1000.0, limit=100):
    t = tasks(spark, ("t", kind, limit, elapsed, None, None))
    return E.score_tasks(t, ranked(spark, ids), truth(spark, correct)).first()


def test_kis_task(spark):
    first = score(spark, "KIS", "ax", "a")
    assert first["ok"] and first["wrong_submissions"] == 0 and first["kis_score"] == pytest.approx(99.5)
    third = score(spark, "KIS", "xya", "a")
    assert third["wrong_submissions"] == 2 and third["kis_score"] == pytest.approx(79.5)
    late = score(spark, "KIS", "x" * 10 + "a", "a")  # found, but below the tenth place
    assert not late["ok"] and late["wrong_submissions"] == 11 and late["kis_score"] == 0.0
    assert late["mrr"] == pytest.approx(1 / 11) and late["time_to_first_correct_ms"] is None


def test_adhoc_task(spark):
    s = score(spark, "AD_HOC", "axbyc", "abz")
    assert (s["adhoc_correct"], s["adhoc_incorrect"], s["wrong_submissions"]) == (2, 3, 3)
    assert s["adhoc_score"] == pytest.approx(100 * 2 / 3.5 * 2 / 3) and s["kis_score"] is None


@pytest.mark.parametrize(
    "ids, correct, ok",
    [("abcdx", "abcd", True), ("bacd", "abcd", False), ("abc", "abcd", False), ("abcd", "abc", False), ("aabb", "aabb", True)],
)
def test_trake_task(spark, ids, correct, ok):
    s = score(spark, "TRAKE", ids, correct)
    assert s["ok"] is ok
    assert s["kis_score"] == (pytest.approx(99.5) if ok else 0.0)
    assert s["wrong_submissions"] == (0 if ok else 1)


def test_qa_task(spark):
    t = tasks(spark, ("q", "QA", 180, 18000.0, "red", ["crimson"]), ("n", "QA", 180, 1.0, "red", None))
    subs = spark.createDataFrame([("q", 1, 1.0, None, "a Crimson flag")], SUBS)
    rows = {r["task_id"]: r for r in E.score_tasks(t, subs, truth(spark, [])).collect()}
    assert rows["q"]["ok"] and rows["q"]["ndcg_at_10"] == 1.0 and rows["q"]["kis_score"] == pytest.approx(95.0)
    assert not rows["n"]["ok"] and rows["n"]["wrong_submissions"] == 1 and rows["n"]["mrr"] == 0.0


def test_no_submissions_at_all(spark):
    t = tasks(spark, ("t", "KIS", 100, 1.0, None, None))
    s = E.score_tasks(t, spark.createDataFrame([], SUBS), truth(spark, "a")).first()
    assert not s["ok"] and s["kis_score"] == 0.0 and s["wrong_submissions"] == 0


def test_roll_up_has_every_type(spark):
    t = tasks(spark, ("t", "KIS", 100, 1000.0, None, None), ("u", "KIS", 100, 3000.0, None, None))
    scores = E.score_tasks(t, ranked(spark, "a"), truth(spark, "a"))
    rows = {r["task_type"]: r for r in E.roll_up(scores).collect()}
    assert set(rows) == {"KIS", "QA", "AD_HOC", "TRAKE", "ALL"}
    assert rows["KIS"]["n"] == rows["ALL"]["n"] == 2 and rows["KIS"]["n_correct"] == 1
    assert rows["KIS"]["mean_kis_score"] == pytest.approx(99.5 / 2)
    assert rows["QA"]["n"] == 0 and rows["QA"]["mean_kis_score"] is None and rows["QA"]["mean_mrr"] == 0.0
    lat = E.latency(scores).first()
    assert lat["n"] == 2 and lat["p50_ms"] == pytest.approx(2000.0)
    none = E.latency(scores.where("false")).first()
    assert (none["n"], none["p50_ms"], none["mean_ms"]) == (0, 0.0, 0.0)
