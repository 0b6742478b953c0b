"""Task scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanefold.functions.text import normalise_answer

# The score formulas' constants.
TIME_PENALTY = 50.0
WRONG_PENALTY = 10.0
FULL_SCORE = 100.0


def _require(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def kis_score(seconds: Column, wrong: Column, limit_seconds: Column) -> Column:
    """Known-item score: time and wrong answers are deducted; NULL time (unsolved) scores 0."""
    share = F.least(seconds / limit_seconds, F.lit(1.0))
    raw = F.lit(FULL_SCORE) - share * TIME_PENALTY - wrong * WRONG_PENALTY
    checked = _require(
        (limit_seconds > 0) & (wrong >= 0),
        F.greatest(F.lit(0.0), raw),
        "time limit must be positive and wrong submissions non-negative",
    )
    return F.when(seconds.isNull(), F.lit(0.0)).otherwise(checked)


def adhoc_score(correct: Column, incorrect: Column, relevant: Column) -> Column:
    """Precision (wrong answers count half) times coverage, out of 100."""
    correct, incorrect, relevant = (c.cast("double") for c in (correct, incorrect, relevant))
    score = FULL_SCORE * (correct / (correct + incorrect / 2.0)) * (correct / relevant)
    return _require(
        (correct >= 0) & (incorrect >= 0) & (relevant >= 0),
        F.when((correct == 0) | (relevant == 0), F.lit(0.0)).otherwise(score),
        "counts must be non-negative",
    )


def qa_correct(answer: Column, canonical: Column, acceptable: Column) -> Column:
    """Whether an acceptable answer contains the given one or is contained in it.

    An empty answer is wrong. A blank one is not empty, and nothing is left of it after
    normalisation, which every target contains: it is right.
    """
    given = normalise_answer(answer)
    targets = F.transform(
        F.concat(F.array(canonical), F.coalesce(acceptable, F.array().cast("array<string>"))),
        normalise_answer,
    )
    match = F.exists(
        targets, lambda t: (t != "") & (F.contains(given, t) | F.contains(t, given))
    )
    present = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(canonical, F.lit("")) != "")
    return F.when(present, match).otherwise(F.lit(False))


def gain(position: Column) -> Column:
    """Discounted gain of a relevant answer at a 1-based position."""
    return 1.0 / F.log2(position.cast("double") + 1.0)


def ideal_gain(relevant: Column, k: int) -> Column:
    """Gain of the best ranking of ``relevant`` answers cut at ``k``."""
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    steps = F.sequence(F.lit(1), F.greatest(F.least(relevant.cast("int"), F.lit(k)), F.lit(1)))
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + gain(i))
    return F.when(relevant > 0, total).otherwise(F.lit(0.0))
