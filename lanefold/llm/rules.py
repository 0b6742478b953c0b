"""Quality rules as a ledger: each rule is evaluated once, policies are masks over the outcome.

``ledger`` measures every text and keeps the measurements with one long of failure bits, bit b
for rule b of ``RULES``. A policy is a named, versioned set of rules; whether a document is kept
is one bitwise test, and a new policy needs no text to be read again. ``ablations`` counts
documents by their bits first, so that what a rule costs under each policy comes from at most
2 ** len(RULES) rows.

Column functions only. Words are runs of anything but the six ASCII white-space characters;
null and empty texts have none and fail the rule on length. A text of any length stays in its
row: repeated windows are found by sorting the window hashes of that row, not by pairs. Repeated
rows get equal results. Other columns pass through, unless they bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import shielded

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# (name, fails when), in the order of the bits; never reorder, only append.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines"),
)
BASE = ("too_few_words", "repeated_words")
POLICIES = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "repeated_lines"),
    "web-2": (*BASE, "word_length", "symbols", "repeated_lines"),
}
POLICY = "web-2"


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of each text as long columns."""
    return shielded(docs, (text,), MEASURES, lambda rows: _measured(rows, text))


def _measured(rows: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each projection uses the arrays of the one before more than once, so none is computed twice.
    rows = rows.select(
        "*",
        without(WHITE_CHARS).cast("long").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.array_remove(F.split(t, WHITE), "").alias("_words"),
        lines.alias("_lines"),
    )
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i"))
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select(
        *[F.col(c) for c in rows.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, F.sort_array(windows)).otherwise(none).alias("_windows"),
    )
    same = lambda x, k: x["h"] == F.get("_windows", k)["h"]
    twice = F.filter(
        "_windows", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))
    )
    rows = rows.select(*[F.col(c) for c in rows.columns if c != "_windows"], twice["i"].alias("_starts"))
    shifted = lambda by: F.transform("_starts", lambda i: i + by)
    covered = F.array_union(F.array_union("_starts", shifted(1)), shifted(2))
    # A generator: filters on the measurements stay above it, instead of doing its work again.
    measures = F.struct(*MEASURES[:-1], F.size(covered).cast("long").alias(MEASURES[-1]))
    passed = [F.col(c) for c in rows.columns if c != "_starts" and c not in MEASURES]
    return rows.select(*passed, F.inline(F.array(measures)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, the failure bits of all rules."""
    bits = [F.when(F.expr(fails), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", failed)


def passes(rules: tuple[str, ...], failed: str = "failed") -> Column:
    """Whether none of these rules failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(rules)).cast("long")) == 0


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(policy, rule, docs, failing, failing_alone, kept, kept_without): what each rule costs.

    ``failing_alone`` documents would be kept if the policy had no such rule.
    """
    spark = entries.sparkSession
    names = [name for name, _ in RULES]
    rows = [(p, r, mask(rules), 1 << names.index(r)) for p, rules in (policies or POLICIES).items() for r in rules]
    cases = spark.createDataFrame(rows, "policy string, rule string, mask bigint, bit bigint")
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return (
        counts.crossJoin(F.broadcast(cases))  # at most 2 ** rules counts, and a row per policy and rule
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("docs"),
            total(hit.bitwiseAND(F.col("bit")) != 0).alias("failing"),
            total(hit == F.col("bit")).alias("failing_alone"),
            total(hit == 0).alias("kept"),
            total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        )
    )


def judge(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, policy)."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(POLICIES[policy])).alias("kept"),
        "failed",
        F.lit(policy).alias("policy"),
    )


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_FAILED = " + ".join(f"CASE WHEN {fails} THEN {1 << b} ELSE 0 END" for b, (_, fails) in enumerate(RULES))

JUDGE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS} AS w, {_LINES} AS l FROM documents),
g AS (SELECT r, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g,
             unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM m WHERE n > 1) GROUP BY r),
e AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (r)),
f AS (SELECT *, ({_FAILED})::BIGINT AS failed FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask(BASE)} <> 0 AS base_failed,
       failed & {mask((*BASE, *POLICIES[POLICY]))} = 0 AS kept, failed, '{POLICY}' AS policy FROM f"""
