"""Noise modes, noisy corpora, and search under noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanefold.embedding.pseudo import PseudoEmbedder, mean_pool
from lanefold.functions import noise as N, vectors as V
from lanefold.functions.hashing import MODULUS
from lanefold.functions.text import strip_marks
from lanefold.operators import corpus as C, profiling as R, robustness as B, sparse as S
from lanefold.plans.inputs import frames, lane_sql, prototype_sql, prototypes, table, texts
from lanefold.plans.registry import query
from lanefold.plans.text_queries import CLEAN_SQL, _measures_sql, _PROFILE_SQL, clean_documents, negatives_sql, nfd_sql

SEED = 0


def uniform_sql(h: str, stream: int, i: str) -> str:
    """The uniform numbers of ``functions.hashing``."""
    x = f"(({h} + {stream * 101390422} + {i} * 69621) % {MODULUS})"
    x = f"(({x} * {x} + {h} + {i}) % {MODULUS})"
    x = f"(({x} * 48271) % {MODULUS})"
    x = f"(({x} * {x} + {stream * 97} + {i}) % {MODULUS})"
    return f"((({x} * 69621) % {MODULUS}) / {MODULUS}.0::DOUBLE)"


def beta_sql(h: str, stream: int) -> str:
    return "list_sort([" + ", ".join(uniform_sql(h, stream, f"{j}::BIGINT") for j in range(6)) + "])[2]"


_MARK = "regexp_matches(ch, '\\p{Mn}')"
_TONE = "coalesce(list_position([" + ", ".join(f"chr({t})" for t in N.TONES) + "], ch), 0)"
_TONES = "[" + ", ".join(f"chr({t})" for t in N.TONES) + "]"


def _chars(relation: str, p: int, text: str) -> str:
    """One row per code point: (doc_id, h, p, i, ch)."""
    return f"""SELECT doc_id, h, p, unnest(cs) AS ch, generate_subscripts(cs, 1) - 1 AS i FROM (
        SELECT doc_id, h, {beta_sql('h', p)} AS p, regexp_extract_all({text}, '(?s).') AS cs FROM ({relation}))"""


def _words(relation: str, p: int) -> str:
    return f"""SELECT doc_id, h, p, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (
        SELECT doc_id, h, {beta_sql('h', p)} AS p, string_split(text, ' ') AS ws FROM ({relation}))"""


def _joined(rows: str, relation: str, order: str = "i", sep: str = "", composed: bool = False) -> str:
    """Pieces ``o`` back to whole texts; a text of no pieces is empty."""
    whole = f"string_agg(o, '{sep}' ORDER BY {order})"
    whole = f"nfc_normalize({whole})" if composed else whole
    return f"""SELECT r.doc_id, r.h, coalesce(j.text, '') AS text FROM ({relation}) r LEFT JOIN (
        SELECT doc_id, {whole} AS text FROM ({rows}) GROUP BY doc_id) j ON j.doc_id = r.doc_id"""


def random_drop_sql(relation: str, p: int, s: int) -> str:
    u = uniform_sql("h", s, "i")
    rows = f"""SELECT doc_id, i, CASE WHEN {_MARK} AND {u} < p THEN '' WHEN ch = 'đ' AND {u} < p THEN 'd'
        WHEN ch = 'Đ' AND {u} < p THEN 'D' ELSE ch END AS o FROM ({_chars(relation, p, nfd_sql('text'))})"""
    return _joined(rows, relation, composed=True)


def tone_swap_sql(relation: str, p: int, s: int) -> str:
    pick = f"(floor({uniform_sql('h', s + 1, 'i')} * 4)::BIGINT + 1)"
    rows = f"""SELECT doc_id, i, CASE WHEN t > 0 AND {uniform_sql('h', s, 'i')} < p
        THEN ({_TONES})[CASE WHEN {pick} < t THEN {pick} ELSE {pick} + 1 END] ELSE ch END AS o
      FROM (SELECT *, {_TONE} AS t FROM ({_chars(relation, p, nfd_sql('text'))}))"""
    return _joined(rows, relation, composed=True)


def space_split_sql(relation: str, p: int, s: int) -> str:
    rows = f"""SELECT doc_id, i, CASE WHEN length(w) >= 2 AND {uniform_sql('h', s, 'i')} < p
        THEN array_to_string(regexp_extract_all(w, '(?s).'), ' ') ELSE w END AS o FROM ({_words(relation, p)})"""
    return _joined(rows, relation, sep=" ")


def char_confuse_sql(relation: str, p: int, s: int) -> str:
    options = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.LOOK_ALIKES.items())
    merged = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.PAIR_ALIKES.items())
    rows = f"""SELECT doc_id, i, CASE WHEN pair IS NOT NULL THEN pair WHEN lag(pair) OVER w IS NOT NULL THEN ''
        WHEN opts IS NOT NULL AND {uniform_sql('h', s + 1, 'i')} < p
          THEN substr(opts, floor({uniform_sql('h', s + 2, 'i')} * length(opts))::BIGINT + 1, 1) ELSE ch END AS o
      FROM (SELECT *, CASE ch {options} END AS opts, CASE WHEN {uniform_sql('h', s, 'i')} < p
          THEN CASE ch || lead(ch) OVER (PARTITION BY doc_id ORDER BY i) {merged} END END AS pair
        FROM ({_chars(relation, p, 'text')})) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
    return _joined(rows, relation)


def word_merge_sql(relation: str, p: int, s: int) -> str:
    rows = f"""SELECT doc_id, i, CASE WHEN ch = ' ' AND {uniform_sql('h', s, 'i')} < p THEN '' ELSE ch END AS o
        FROM ({_chars(relation, p, 'text')})"""
    return _joined(rows, relation)


def case_noise_sql(relation: str, p: int, s: int) -> str:
    cs = "regexp_extract_all(w, '(?s).')"
    title = f"""array_to_string(list_transform({cs}, lambda c, k: CASE
        WHEN k > 1 AND regexp_matches(({cs})[k - 1], '\\p{{L}}') THEN lower(c) WHEN c = 'ß' THEN 'Ss' ELSE upper(c) END), '')"""
    rows = f"""SELECT doc_id, i, CASE WHEN len(forms) > 0
        THEN forms[floor({uniform_sql('h', s + 1, 'i')} * len(forms))::BIGINT + 1] ELSE w END AS o
      FROM (SELECT *, CASE WHEN {uniform_sql('h', s, 'i')} < p
          THEN list_filter([lower(w), upper(replace(w, 'ß', 'SS')), {title}], lambda f: f <> w) END AS forms
        FROM ({_words(relation, p)}))"""
    return _joined(rows, relation, sep=" ")


def homophone_swap_sql(relation: str, p: int, s: int) -> str:
    pick = f"floor({uniform_sql('h', s + 1, 'b')} * 5)::BIGINT"
    rows = f"""SELECT doc_id, i, CASE WHEN hit AND i > b AND i = first_tone THEN '' ELSE ch END
          || CASE WHEN hit AND i = last_i THEN (['', {_TONES[1:-1]}])[CASE WHEN {pick} < cur THEN {pick} ELSE {pick} + 1 END + 1] ELSE '' END AS o
      FROM (SELECT *, coalesce(max(CASE WHEN i = first_tone THEN t END) OVER (PARTITION BY doc_id, b), 0) AS cur FROM (
        SELECT *, max(i) OVER (PARTITION BY doc_id, b) AS last_i,
          min(CASE WHEN t > 0 THEN i END) OVER (PARTITION BY doc_id, b) AS first_tone,
          bool_or(i = b AND contains('{N.VOWELS}', ch) AND {uniform_sql('h', s, 'i')} < p) OVER (PARTITION BY doc_id, b) AS hit
        FROM (SELECT *, {_TONE} AS t, max(CASE WHEN NOT {_MARK} THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS b
          FROM ({_chars(relation, p, nfd_sql('text'))}))))"""
    return _joined(rows, relation, composed=True)


def drop_all_sql(relation: str) -> str:
    plain = f"regexp_replace({nfd_sql('text')}, '\\p{{Mn}}', '', 'g')"
    return f"SELECT doc_id, h, replace(replace({plain}, 'đ', 'd'), 'Đ', 'D') AS text FROM ({relation})"


def mode_sql(mode: str, source: str, seed: int = SEED) -> str:
    """(doc_id, h, text): one mode over a relation (doc_id, text)."""
    keyed = f"""SELECT doc_id, text, ('0x' || substr(md5('{seed}|{mode}|' || text), 1, 7))::BIGINT AS h FROM ({source})"""
    if mode == "drop_all":
        return drop_all_sql(keyed)
    if mode == "mixed":
        return tone_swap_sql(random_drop_sql(keyed, 1, 2), 3, 4)
    if mode == "mixed_ocr":
        return space_split_sql(char_confuse_sql(random_drop_sql(keyed, 1, 2), 3, 4), 7, 8)
    single = {
        "random_drop": random_drop_sql,
        "tone_swap": tone_swap_sql,
        "space_split": space_split_sql,
        "char_confuse": char_confuse_sql,
        "word_merge": word_merge_sql,
        "homophone_swap": homophone_swap_sql,
        "case_noise": case_noise_sql,
    }
    return single[mode](keyed, 1, 2)


def _register(mode: str) -> None:
    sql = mode_sql(mode, "SELECT doc_id, text FROM documents")

    @query(f"noise_{mode}", f"SELECT doc_id, md5(text) AS noisy_md5, length(text) AS n FROM ({sql})")
    def run(spark, sf):
        noisy = texts(spark, sf).select("doc_id", N.noise(F.col("text"), mode, SEED).alias("noisy"))
        return noisy.select("doc_id", F.md5("noisy").alias("noisy_md5"), F.char_length("noisy").cast("long").alias("n"))


for _mode in N.MODES:
    _register(_mode)


def _all_modes_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {i} AS variant, '{mode}' AS mode, text FROM ({mode_sql(mode, source)})"
        for i, mode in enumerate(N.MODES)
    )


@query(
    "noise_variants",
    "SELECT doc_id, variant::BIGINT AS variant, mode, md5(text) AS noisy_md5 FROM ("
    + _all_modes_sql("SELECT item_id AS doc_id, text FROM benchmark")
    + ")",
)
def noise_variants(spark, sf):
    rows = texts(spark, sf, "benchmark").select("item_id", F.inline(N.variants(F.col("text"), seed=SEED)))
    return rows.select(
        F.col("item_id").alias("doc_id"), F.col("variant").cast("long").alias("variant"), "mode", F.md5("noisy").alias("noisy_md5")
    )


@query(
    "corpus_pairs",
    negatives_sql(3)
    + f""", n AS (SELECT a.doc_id, string_agg(md5(c.norm), ',' ORDER BY slot) AS negs FROM asks a JOIN c ON c.idx = a.at GROUP BY a.doc_id)
      SELECT p.doc_id, variant::BIGINT AS variant, mode, md5(c.norm) AS anchor_md5, md5(p.text) AS noisy_md5, negs AS negatives_md5
      FROM ({_all_modes_sql(f"SELECT doc_id, norm AS text FROM ({CLEAN_SQL})")}) p JOIN c USING (doc_id) JOIN n USING (doc_id)""",
)
def corpus_pairs(spark, sf):
    """The whole corpus build: de-duplicate, mine negatives, make every variant."""
    pairs = C.contrastive_pairs(clean_documents(spark, sf), hard_negatives_per_anchor=3, seed=SEED, order="doc_id", told_by=F.md5)
    return pairs.select(
        "doc_id",
        F.col("variant").cast("long").alias("variant"),
        "mode",
        F.col("anchor_clean").alias("anchor_md5"),
        F.md5("positive_noisy").alias("noisy_md5"),
        F.array_join("hard_negs", ",").alias("negatives_md5"),
    )


@query(
    "noise_profile_by_mode",
    f"SELECT mode, {_PROFILE_SQL} FROM ("
    + _measures_sql("(" + _all_modes_sql("SELECT item_id AS doc_id, text FROM benchmark") + ")")
    + ") GROUP BY mode",
)
def noise_profile_by_mode(spark, sf):
    return R.profile_noise(texts(spark, sf, "benchmark"), "text", "item_id", seed=SEED, max_anchors=None)


@query("pseudo_embed")
def pseudo_embed(spark, sf):
    """Unit vectors of all documents, drawn from generators seeded by their text."""
    embedder = PseudoEmbedder()
    vectors = texts(spark, sf).select("doc_id", embedder.encode_text(F.col("text")).alias("v"))
    return vectors.select(
        "doc_id", F.round(V.norm(F.col("v")), 5).alias("norm"), F.round(F.col("v")[0].cast("double"), 6).alias("first")
    )


@query("token_mean_pool")
def token_mean_pool(spark, sf):
    embedder = PseudoEmbedder()
    pooled = mean_pool(embedder.encode_tokens(F.col("text")), embedder.dim)
    vectors = table(spark, sf, "benchmark").select("item_id", pooled.alias("v"))
    return vectors.select("item_id", F.round(V.norm(F.col("v")), 5).alias("norm"))


GRAMS = 6


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _others(spark, sf):
    """Turns of all conversations are documents beside the questions themselves."""
    return table(spark, sf, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("did"), "text")


_grams = S.CharGrams(GRAMS)
_folded_grams = S.CharGrams(GRAMS, lambda text: F.lower(strip_marks(text)))


_FOLD_SQL = f"replace(replace(regexp_replace({nfd_sql('text')}, '\\p{{Mn}}', '', 'g'), 'đ', 'd'), 'Đ', 'D')"
_WORDS_SQL = "list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _terms_sql(kind: str) -> str:
    """(id, term) of a relation (id, text) named ``r``."""
    if kind == "words":
        return f"SELECT id, unnest({_WORDS_SQL}) AS term FROM r"
    text = f"lower({_FOLD_SQL})" if kind == "folded" else "text"
    # The code points of a text are taken once.
    return f"""SELECT id, unnest(CASE WHEN len(cs) >= {GRAMS} THEN list_transform(range(1, len(cs) - {GRAMS - 2}), lambda i: {" || ".join(f"cs[i + {j}]" for j in range(GRAMS))})
        WHEN len(cs) = 0 THEN [] ELSE [array_to_string(cs, '')] END) AS term FROM (SELECT id, regexp_extract_all({text}, '(?s).') AS cs FROM r)"""


def _degradation_sql(kind: str, k: int = 10) -> str:
    modes = [*N.MODES]
    asked = "SELECT item_id AS own, 'clean' AS mode, text FROM benchmark UNION ALL SELECT doc_id, mode, text FROM (" + _all_modes_sql(
        "SELECT item_id AS doc_id, text FROM benchmark"
    ) + ")"
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(modes))
    return f"""WITH asked AS MATERIALIZED (SELECT row_number() OVER () AS id, own, mode, text FROM ({asked})),
      docs AS MATERIALIZED (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations),
      dt AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM ({_terms_sql(kind).replace("FROM r", "FROM docs")}) GROUP BY ALL),
      idf AS MATERIALIZED (SELECT term, ln(1 + (SELECT count(DISTINCT id) FROM dt)::DOUBLE / count(*)) AS idf FROM dt GROUP BY term),
      dw AS MATERIALIZED (SELECT id AS did, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM dt JOIN idf USING (term)),
      qw AS MATERIALIZED (SELECT id, term, count(*) * any_value(idf) AS q FROM ({_terms_sql(kind).replace("FROM r", "FROM asked")}) JOIN idf USING (term) GROUP BY id, term),
      hits AS (SELECT * FROM (SELECT id, did, row_number() OVER (PARTITION BY id ORDER BY score DESC, did) AS rank FROM (
        SELECT id, did, round(sum(q * w), 9) AS score FROM qw JOIN dw USING (term) GROUP BY id, did)) WHERE rank <= {k}),
      recall AS MATERIALIZED (SELECT mode, count(did)::DOUBLE / count(*) AS r FROM asked LEFT JOIN hits ON hits.id = asked.id AND did = own GROUP BY mode),
      kept AS MATERIALIZED (SELECT mode, CASE WHEN c > 0 THEN r / c ELSE 0.0 END AS degradation FROM recall, (SELECT r AS c FROM recall WHERE mode = 'clean') WHERE mode <> 'clean')
      SELECT mode, degradation FROM kept
      UNION ALL SELECT 'overall', list_sum(list(degradation ORDER BY CASE mode {order} END)) / {len(modes)}.0::DOUBLE FROM kept"""


@query("degradation_at_k", f"SELECT mode, round(degradation, 6) AS degradation FROM ({_degradation_sql('grams')})")
def degradation_at_k(spark, sf):
    """Search by character n-grams for the benchmark texts under every noise mode, among them and all conversations."""
    scores = B.degradation_at_k(_questions(spark, sf), B.sparse_retriever(_grams), k=10, seed=SEED, others=_others(spark, sf))
    return scores.select("mode", F.round("degradation", 6).alias("degradation"))


_GATE_SQL = " CROSS JOIN ".join(
    f"(SELECT round(degradation, 9) AS {name} FROM ({_degradation_sql(kind)}) WHERE mode = 'overall')"
    for name, kind in (("overall", "folded"), ("baseline_maxsim", "words"), ("baseline_dense", "grams"))
)


@query(
    "robustness_verdict",
    f"""SELECT {B.SHIP_GATE_TARGET}::DOUBLE AS target, *, overall >= {B.SHIP_GATE_TARGET}::DOUBLE AS passes_absolute,
        overall > baseline_maxsim AS beats_maxsim, overall > baseline_dense AS beats_dense,
        overall >= {B.SHIP_GATE_TARGET}::DOUBLE AND overall > baseline_maxsim AND overall > baseline_dense AS passes_ship_gate
      FROM {_GATE_SQL}""",
)
def robustness_verdict(spark, sf):
    """N-grams of folded texts against words and against n-grams of the texts as they are."""
    asked, others = _questions(spark, sf), _others(spark, sf)

    def overall(terms):
        scores = B.degradation_at_k(asked, B.sparse_retriever(terms), seed=SEED, others=others)
        return scores.withColumn("degradation", F.round("degradation", 9))

    return B.ship_gate(overall(_folded_grams), overall(S.space_words), overall(_grams))


_GOLD_SQL = " UNION ALL ".join(
    f"""SELECT label AS example_id, '{lane}' AS retriever, rank FROM (
        SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank,
          min(vec_id) OVER (PARTITION BY label) AS gold
        FROM (SELECT d.label, d.vec_id, round(list_dot_product(q.qvec, d.vec), 9) AS score
              FROM ({lane_sql(lane)}) d JOIN ({prototype_sql(lane)}) q ON q.qid = d.label)) WHERE vec_id = gold"""
    for lane in "abc"
)
_VERDICT_SQL = """CASE WHEN c IS NULL OR b IS NULL THEN 'n/a' WHEN c > b THEN 'loss' WHEN c = b THEN 'tie'
    WHEN c <= 10 AND b > 10 THEN 'clean_win' WHEN c > 10 THEN 'graceful' ELSE 'tie' END"""


def _gold_ranks(spark, sf, lane):
    """Rank of each label's first vector among the label's vectors, by likeness to the prototype."""
    docs = frames(spark, sf, lane)
    scores = docs.join(prototypes(spark, sf, lane), docs["label"] == F.col("qid")).select(
        "qid", F.col("vec_id").alias("did"), F.round(V.dot(F.col("qvec"), F.col("vec")), 9).alias("score")
    )
    gold = docs.groupBy(F.col("label").cast("long").alias("qid")).agg(F.min("vec_id").alias("gold"))
    return B.gold_ranks(scores, gold).select(F.col("qid").alias("example_id"), F.lit(lane).alias("retriever"), "rank")


@query(
    "gold_rank_verdict",
    f"""SELECT example_id::BIGINT AS example_id, c AS candidate_rank, b AS best_baseline, {_VERDICT_SQL} AS verdict FROM (
        SELECT example_id, min(rank) FILTER (retriever = 'a') AS c, min(rank) FILTER (retriever <> 'a') AS b
        FROM ({_GOLD_SQL}) GROUP BY example_id)""",
)
def gold_rank_verdict(spark, sf):
    ranks = _gold_ranks(spark, sf, "a").unionByName(_gold_ranks(spark, sf, "b")).unionByName(_gold_ranks(spark, sf, "c"))
    return B.verdicts(ranks, "a")


_USER_RANKS_SQL = "SELECT user_id AS example_id, event_type AS retriever, count(*) FILTER (value > 12) + 1 AS rank FROM events GROUP BY ALL"


def _user_ranks(spark, sf):
    """Each user as an example, each event type as a retriever, ranked by its number of large values."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("example_id"), F.col("event_type").alias("retriever"))
        .agg((F.count_if(F.col("value") > 12) + 1).alias("rank"))
    )


@query(
    "verdict_tally",
    f"""SELECT count(*) FILTER (v = 'clean_win') AS clean_wins, count(*) FILTER (v = 'tie') AS ties,
        count(*) FILTER (v = 'graceful') AS graceful, count(*) FILTER (v = 'loss') AS losses FROM (
        SELECT {_VERDICT_SQL} AS v FROM (SELECT example_id, min(rank) FILTER (retriever = 'view') AS c,
            min(rank) FILTER (retriever <> 'view') AS b FROM ({_USER_RANKS_SQL}) GROUP BY example_id))""",
)
def verdict_tally(spark, sf):
    return B.tally(B.verdicts(_user_ranks(spark, sf), "view"))


@query(
    "best_seed_argmax",
    f"""SELECT grp, seed, c AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cls, gap, c, seed) AS n FROM (
        SELECT *, CASE v WHEN 'clean_win' THEN 0 WHEN 'graceful' THEN 1 ELSE 2 END AS cls,
          CASE WHEN v = 'clean_win' THEN c - b ELSE 0 END AS gap FROM (
          SELECT *, {_VERDICT_SQL} AS v FROM (
            SELECT hour(ts) AS grp, user_id AS seed, count(*) FILTER (event_type = 'view') * 3 + 1 AS c,
              count(*) FILTER (event_type <> 'view') * 3 + 1 AS b FROM events GROUP BY ALL)))) WHERE n = 1""",
)
def best_seed_argmax(spark, sf):
    """Hours as sweeps, users as seeds."""
    kind = F.col("event_type")
    seen = table(spark, sf, "events").groupBy(F.hour("ts").cast("long").alias("grp"), F.col("user_id").alias("seed")).agg(
        (F.count_if(kind == "view") * 3 + 1).alias("candidate_rank"),
        (F.count_if(kind != "view") * 3 + 1).alias("best_baseline"),
    )
    return B.best_seed(seen, ["grp"])
