"""Normalisation, de-duplication, splitting, profiling and held-out selection of texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions import text as X
from lanefold.functions.hashing import HALF_KEY, MODULUS, PERMUTATION_ROUNDS
from lanefold.operators import corpus as C, profiling as R
from lanefold.plans.inputs import table, texts
from lanefold.plans.registry import query


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return f"replace(lower({norm_sql(x)}), 'ß', 'ss')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


MARKED = "".join(
    chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if X.carries_mark(chr(c))
)
LATIN = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]


def nfd_sql(x: str) -> str:
    """Latin letters taken apart; the texts hold no others."""
    for ch in LATIN:
        x = f"replace({x}, '{ch}', '{unicodedata.normalize('NFD', ch)}')"
    return x


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", "text")


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_spellings(_docs(spark, sf), "text", ["doc_id"])


CLEAN_SQL = f"""SELECT doc_id, norm FROM (SELECT doc_id, {norm_sql('text')} AS norm,
      row_number() OVER (PARTITION BY {key_sql('text')} ORDER BY doc_id) AS n FROM documents
    WHERE length({norm_sql('text')}) >= 4) WHERE n = 1"""


@query(
    "text_normalize",
    f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, md5({key_sql('text')}) AS key_md5, length({norm_sql('text')}) AS n FROM documents",
)
def text_normalize(spark, sf):
    x = F.col("text")
    return _docs(spark, sf).select(
        "doc_id",
        F.md5(X.collapse_spaces(x)).alias("norm_md5"),
        F.md5(X.dedup_key(x)).alias("key_md5"),
        F.char_length(X.collapse_spaces(x)).cast("long").alias("n"),
    )


@query("text_normalize_dedup", f"SELECT doc_id, md5(norm) AS norm_md5, length(norm) AS n FROM ({CLEAN_SQL})")
def text_normalize_dedup(spark, sf):
    return clean_documents(spark, sf).select(
        "doc_id", F.md5("text").alias("norm_md5"), F.char_length("text").cast("long").alias("n")
    )


def _sentences_sql(relation: str, key: str) -> str:
    return f"""SELECT {key}, generate_subscripts(s, 1) - 1 AS part, unnest(s) AS text FROM (
        SELECT {key}, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda p: {strip_sql('p')}),
          lambda p: length(p) BETWEEN 15 AND 300) AS s FROM {relation})"""


def _sentences(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return C.row_strings(texts(spark, sf, name).select(key, "text"), key, ["text"], split=True)


@query("sentence_split", f"SELECT doc_id, part, md5(text) AS sentence_md5, length(text) AS n FROM ({_sentences_sql('documents', 'doc_id')})")
def sentence_split(spark, sf):
    return _sentences(spark, sf, "documents", "doc_id").select(
        "doc_id",
        F.col("part").cast("long").alias("part"),
        F.md5("text").alias("sentence_md5"),
        F.char_length("text").cast("long").alias("n"),
    )


_PROSE = "(contains({s}, ' ') AND length({s}) >= 15 AND NOT contains({s}, '://'))"


@query(
    "prose_filter",
    f"""SELECT page_id, {_PROSE.format(s=strip_sql('html'))} AS html_is_prose, {_PROSE.format(s=strip_sql('url'))} AS url_is_prose FROM pages""",
)
def prose_filter(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        X.looks_like_prose(F.col("html")).alias("html_is_prose"),
        X.looks_like_prose(F.col("url")).alias("url_is_prose"),
    )


@query(
    "row_strings_auto",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY col) - 1 AS part, md5(s) AS text_md5 FROM (
        SELECT doc_id, 1 AS col, text AS s FROM documents UNION ALL SELECT doc_id, 2, lang FROM documents
        UNION ALL SELECT doc_id, 3, source FROM documents) WHERE {_PROSE.format(s=strip_sql('s'))}""",
)
def row_strings_auto(spark, sf):
    """Columns that read like prose are found row by row."""
    found = C.row_strings(texts(spark, sf).drop("n_chars"), "doc_id")
    return found.select("doc_id", F.col("part").cast("long").alias("part"), F.md5("text").alias("text_md5"))


_CLEAN_SENTENCES = f"""SELECT doc_id, part, norm FROM (SELECT doc_id, part, {norm_sql('text')} AS norm,
      row_number() OVER (PARTITION BY {key_sql('text')} ORDER BY doc_id, part) AS n FROM ({_sentences_sql('documents', 'doc_id')}))
    WHERE n = 1"""


@query(
    "heldout_anti_join",
    f"""SELECT doc_id, part, md5(norm) AS text_md5 FROM ({_CLEAN_SENTENCES})
      WHERE {key_sql('norm')} NOT IN (SELECT {key_sql('text')} FROM ({_sentences_sql('benchmark', 'item_id')}))""",
)
def heldout_anti_join(spark, sf):
    """Document sentences that are no benchmark sentence."""
    clean = C.first_spellings(_sentences(spark, sf, "documents", "doc_id"), "text", ["doc_id", "part"])
    anchors = _sentences(spark, sf, "benchmark", "item_id").select("text")
    return C.held_out(clean, anchors).select(
        "doc_id", F.col("part").cast("long").alias("part"), F.md5("text").alias("text_md5")
    )


@query(
    "ordered_append",
    """WITH u AS (SELECT 0 AS source, item_id AS ord, text FROM benchmark WHERE trim(text) <> ''
        UNION ALL SELECT 1, doc_id, text FROM documents)
      SELECT source::BIGINT AS source, ord, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, ord) AS n FROM u) WHERE n = 1""",
)
def ordered_append(spark, sf):
    """The benchmark as document pool, then documents not in it."""
    base = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), "text")
    extra = _docs(spark, sf).select(F.col("doc_id").alias("ord"), "text")
    return C.append_missing(base, extra, "text", "ord").select(
        F.col("source").cast("long").alias("source"), "ord", F.md5("text").alias("text_md5")
    )


@query(
    "source_union",
    """SELECT 0::BIGINT AS source_ord, doc_id AS ord, md5(text) AS text_md5 FROM documents
      UNION ALL SELECT 3, conv_id * 1000 + turn, md5(text) FROM conversations""",
)
def source_union(spark, sf):
    """Four sources, of which one fails to load and one is empty."""
    rows, _, _ = C.union_sources(
        [
            ("documents", lambda: _docs(spark, sf).withColumnRenamed("doc_id", "ord")),
            ("absent", lambda: table(spark, sf, "no_such_table")),
            ("empty", lambda: _docs(spark, sf).where(F.length("text") < 0).withColumnRenamed("doc_id", "ord")),
            (
                "conversations",
                lambda: table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text"),
            ),
        ]
    )
    return rows.select(F.col("source_ord").cast("long").alias("source_ord"), "ord", F.md5("text").alias("text_md5"))


@query(
    "source_cap",
    """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS t,
        (SELECT sum(n_chars) // 2 FROM documents) AS cap FROM documents) WHERE t - n_chars < cap""",
)
def source_cap(spark, sf):
    """Whole rows until half of all characters are reached; the last row may overshoot."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    cap = docs.agg(F.expr("sum(n_chars) div 2")).first()[0]
    return C.cap_source(docs, "doc_id", F.col("n_chars"), cap)


def _measures_sql(relation: str) -> str:
    return f"""SELECT *, length(text) AS c, len(string_split({norm_sql('text')}, ' ')) AS w,
      length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters,
      length(regexp_replace(text, '[^{MARKED}]', '', 'g')) AS marked,
      length(regexp_replace(text, '[^\\p{{Nd}}²³¹]', '', 'g')) AS digits,
      length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS uppers,
      length(text) - length(replace(text, ' ', '')) AS spaces,
      len(list_filter(string_split({norm_sql('text')}, ' '), lambda t: length(t) = 1)) AS singles
    FROM {relation} WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""

_PROFILE_SQL = """count(*) AS n, printf('%.2f', (avg(c))::DOUBLE)::DOUBLE AS char_len_mean, printf('%.2f', (quantile_cont(c, 0.5))::DOUBLE)::DOUBLE AS char_len_median,
    printf('%.2f', (avg(w))::DOUBLE)::DOUBLE AS word_len_mean, printf('%.4f', (avg(CASE WHEN letters > 0 THEN marked / letters ELSE 0 END))::DOUBLE)::DOUBLE AS diacritic_ratio_mean,
    printf('%.4f', (avg(digits / c))::DOUBLE)::DOUBLE AS digit_ratio_mean, printf('%.4f', (avg(CASE WHEN letters > 0 THEN uppers / letters ELSE 0 END))::DOUBLE)::DOUBLE AS upper_ratio_mean,
    printf('%.4f', (avg(spaces / c))::DOUBLE)::DOUBLE AS space_ratio_mean, printf('%.4f', (avg(singles / w))::DOUBLE)::DOUBLE AS single_char_token_ratio_mean"""


@query("text_profile_by_lang", f"SELECT lang, {_PROFILE_SQL} FROM ({_measures_sql('documents')}) GROUP BY lang")
def text_profile_by_lang(spark, sf):
    return R.profile_text(texts(spark, sf, "documents"), ["lang"], "text")


@query("text_profile_overall", f"SELECT {_PROFILE_SQL} FROM ({_measures_sql('conversations')})")
def text_profile_overall(spark, sf):
    return R.profile_text(texts(spark, sf, "conversations"), [], "text")


@query(
    "profile_compare_flags",
    f"""WITH a AS (SELECT {_PROFILE_SQL} FROM ({_measures_sql('documents')})),
        q AS (SELECT {_PROFILE_SQL} FROM ({_measures_sql('benchmark')})),
        f AS (SELECT list_filter([
          CASE WHEN q.char_len_mean > 0 AND (a.char_len_mean / q.char_len_mean >= 2 OR q.char_len_mean / a.char_len_mean >= 2)
            THEN 'anchor length: ' || printf('%.0f', a.char_len_mean) || ' vs ' || printf('%.0f', q.char_len_mean) || ' chars ('
              || CASE WHEN a.char_len_mean > q.char_len_mean THEN 'longer' ELSE 'shorter' END || ')' END,
          CASE WHEN abs(a.diacritic_ratio_mean - q.diacritic_ratio_mean) >= 0.10
            THEN 'diacritic density: ' || printf('%.2f', a.diacritic_ratio_mean) || ' vs ' || printf('%.2f', q.diacritic_ratio_mean) END
          ], lambda x: x IS NOT NULL) AS flags FROM a, q)
      SELECT array_to_string(flags, '; ') AS flags, CASE WHEN len(flags) = 0 THEN 'profiles agree'
        ELSE 'profiles differ in ' || len(flags) || ' respect(s)' END AS verdict FROM f""",
)
def profile_compare_flags(spark, sf):
    anchor = R.profile_text(texts(spark, sf, "documents"), [], "text")
    asked = R.profile_text(texts(spark, sf, "benchmark"), [], "text")
    return R.calibration_flags(anchor, asked, None, None).select(
        F.array_join("flags", "; ").alias("flags"), "verdict"
    )


@query(
    "query_set_stats",
    f"""SELECT role, count(*) AS n_strings, printf('%.1f', (avg(c))::DOUBLE)::DOUBLE AS char_mean, quantile_cont(c, 0.5)::DOUBLE AS char_median,
        min(c) AS char_min, max(c) AS char_max, printf('%.1f', (avg(w))::DOUBLE)::DOUBLE AS word_mean, quantile_cont(w, 0.5)::DOUBLE AS word_median,
        max(w)::BIGINT AS word_max, printf('%.3f', (avg(CASE WHEN letters > 0 THEN marked / letters ELSE 0 END))::DOUBLE)::DOUBLE AS diacritic_ratio_mean,
        printf('%.3f', (avg((marked > 0)::INT))::DOUBLE)::DOUBLE AS share_with_diacritics
      FROM ({_measures_sql('conversations')}) GROUP BY role""",
)
def query_set_stats(spark, sf):
    return R.query_set_stats(texts(spark, sf, "conversations"), ["role"], "text")


@query(
    "strip_diacritics",
    f"""SELECT doc_id, md5(s) AS plain_md5, length(s) AS n FROM (SELECT doc_id,
        replace(replace(regexp_replace({nfd_sql('text')}, '\\p{{Mn}}', '', 'g'), 'đ', 'd'), 'Đ', 'D') AS s FROM documents)""",
)
def strip_diacritics(spark, sf):
    plain = X.strip_marks(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.md5(plain).alias("plain_md5"), F.char_length(plain).cast("long").alias("n")
    )


@query(
    "issue_titles",
    f"""SELECT conv_id, turn, '[feedback] ' || CASE WHEN length({strip_sql('text')}) > 60 THEN substr(replace({strip_sql('text')}, chr(10), ' '), 1, 59) || '…'
        ELSE replace({strip_sql('text')}, chr(10), ' ') END AS title FROM conversations""",
)
def issue_titles(spark, sf):
    flat = F.replace(X.strip_spaces(F.col("text")), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("[feedback] "), X.elide(flat, 60)).alias("title")
    )


def _permuted_sql(relation: str) -> str:
    """``v`` of (v, n, a, b, high, low, ...) through the keyed permutation of ``functions.hashing``."""
    sql = f"SELECT *, v // b AS l, v % b AS r FROM {relation}"
    for i in range(PERMUTATION_ROUNDS):
        side, other, width = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        t = f"(({other} * 69621 + high + {i * 101390422}) % {MODULUS})"
        stirred = f"((({t} * {t} + low + {i}) % {MODULUS}) * 48271 % {MODULUS})"
        sql = f"SELECT * REPLACE (({side} + {stirred}) % {width} AS {side}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS v) FROM ({sql})"


def negatives_sql(n: int) -> str:
    """CTEs ``c`` (doc_id, norm, idx, total) and ``asks`` (doc_id, slot, at)."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (
      SELECT doc_id, norm, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM ({CLEAN_SQL})),
    drawn AS (SELECT *, (n + a - 1) // a AS b FROM (
      SELECT doc_id, idx, total, slot, slot AS v, total - 1 AS n, floor(sqrt(total - 2))::BIGINT + 1 AS a, key >> 30 AS high, key & {HALF_KEY - 1} AS low
      FROM (SELECT *, ('0x' || substr(md5('0|hardnegs|' || idx), 1, 15))::BIGINT AS key FROM c), range(0, {n}) AS r(slot) WHERE slot < total - 1)),
    walk AS ({_permuted_sql("drawn")} UNION ALL {_permuted_sql("(SELECT * FROM walk WHERE v >= n)")}),
    asks AS (SELECT doc_id, slot, (idx + 1 + v) % total AS at FROM walk WHERE v < n)"""


@query("hard_negatives", negatives_sql(7) + " SELECT a.doc_id, slot, md5(c.norm) AS negative_md5 FROM asks a JOIN c ON c.idx = a.at")
def hard_negatives(spark, sf):
    negs = C.hard_negatives(clean_documents(spark, sf), 7, order="doc_id")
    return negs.select("doc_id", F.col("slot").cast("long").alias("slot"), F.md5("negative").alias("negative_md5"))


@query(
    "seeded_sample",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 100",
)
def seeded_sample(spark, sf):
    return C.seeded_sample(_docs(spark, sf), "doc_id", 100, 3).select("doc_id", F.md5("text").alias("text_md5"))
