"""Text functions against Python's own string methods, noise properties, corpus operators."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanefold.functions import hashing as H, noise as N, text as X
from lanefold.functions.json_leaves import string_leaves
from lanefold.functions.numbers import round_half_even
from lanefold.operators import corpus as C, profiling as R

SAMPLES = [
    "", "  ", "a", "Hà Nội  mùa\tthu", "đường ĐÌNH", "STRASSE straße ẞ", "ΑΣ ς Σ", "İstanbul ŉ ﬁx", "x y z\x1cw",
    "é b", "12 ²³ ٣ ①", "日本語 がぎ", "🙂 a b c", "q u ả t á o", "ALL CAPS here", "http://a b c d e f g h",
    "Một câu dài vừa đủ. Ngắn! Câu thứ ba cũng đủ dài?\nDòng cuối cùng nữa", "Ångström Å", "힣 한글",
]


def apply(spark, fn, values=SAMPLES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["v"] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def collapse(s):
    return re.sub(r"\s+", " ", s).strip()


def test_collapse_and_keys(spark):
    assert apply(spark, X.collapse_spaces) == [collapse(s) for s in SAMPLES]
    assert apply(spark, X.dedup_key) == [collapse(s).casefold() for s in SAMPLES]
    assert apply(spark, X.strip_spaces) == [s.strip() for s in SAMPLES]
    assert apply(spark, X.is_blank) == [not s.strip() for s in SAMPLES]


def test_casefold_of_every_folding_letter(spark):
    special = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF and chr(c).casefold() != chr(c)]
    assert apply(spark, X.casefold, special) == [c.casefold() for c in special]


def test_strip_marks(spark):
    def plain(s):
        kept = [c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)]
        return unicodedata.normalize("NFC", "".join(kept).replace("đ", "d").replace("Đ", "D"))

    latin = [s for s in SAMPLES if not re.search("[가-힣が-ぎÅ]", s)]
    once = apply(spark, X.strip_marks, latin)
    assert once == [plain(s) for s in latin]
    assert apply(spark, X.strip_marks, once) == once


def test_sentences_and_prose(spark):
    def pieces(s):
        return [p.strip() for p in re.split(r"[.!?\n]+", s) if 15 <= len(p.strip()) <= 300]

    assert apply(spark, X.sentences) == [pieces(s) for s in SAMPLES]
    prose = [" " in s.strip() and len(s.strip()) >= 15 and "://" not in s for s in SAMPLES]
    assert apply(spark, X.looks_like_prose) == prose


def ratios(s):
    alpha = [c for c in s if c.isalpha()]
    words = s.split()

    def per(n, d):
        return n / d if d else 0.0

    return {
        "diacritic_ratio": per(sum(X.carries_mark(c) for c in alpha), len(alpha)),
        "digit_ratio": per(sum(c.isdigit() for c in s), len(s)),
        "upper_ratio": per(sum(c.isupper() for c in s), len(alpha)),
        "space_ratio": per(s.count(" "), len(s)),
        "single_char_token_ratio": per(sum(len(w) == 1 for w in words), len(words)),
    }


def test_ratios(spark):
    for name in ("diacritic_ratio", "digit_ratio", "upper_ratio", "space_ratio", "single_char_token_ratio"):
        got = apply(spark, getattr(X, name))
        assert got == pytest.approx([ratios(s)[name] for s in SAMPLES]), name
    assert apply(spark, X.word_count) == [len(s.split()) for s in SAMPLES]


def test_profile(spark):
    texts = [s for s in SAMPLES if s.strip()]
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    row = R.profile_text(df, [], "t").first()
    assert row["n"] == len(texts)
    assert row["char_len_mean"] == round(float(np.mean([len(s) for s in texts])), 2)
    assert row["char_len_median"] == round(float(np.median([len(s) for s in texts])), 2)
    for name in ratios(""):
        assert row[f"{name}_mean"] == pytest.approx(round(float(np.mean([ratios(s)[name] for s in texts])), 4), abs=1e-4)
    with pytest.raises(ValueError):
        R.require_strings(R.profile_text(df.where("t = ''").where("false"), ["t"], "t"))


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [281.225, 2.675, 0.125, 0.375, -2.5, 1e9 + 0.005, 0.0] + [rng.uniform(-1000, 1000) for _ in range(500)]
    values += [round(rng.uniform(0, 1000), 3) + 0.005 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["r"] for r in df.select("i", round_half_even(F.col("v"), 2).alias("r")).orderBy("i").collect()]
    assert got == [round(v, 2) for v in values]


def test_calibration_flags(spark):
    def profile(**over):
        base = dict.fromkeys(R.MEASURES, 0.0) | over
        return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))

    row = R.calibration_flags(profile(char_len_mean=10.0), profile(char_len_mean=100.0), None, None).first()
    assert len(row["flags"]) == 1 and "shorter" in row["flags"][0] and row["verdict"] == "profiles differ in 1 respect(s)"
    same = profile(char_len_mean=10.0)
    assert R.calibration_flags(same, same, same, same).first()["verdict"] == "profiles agree"
    row = R.calibration_flags(None, None, profile(single_char_token_ratio_mean=0.6, digit_ratio_mean=0.1), profile()).first()
    assert [f.split(":")[0] for f in row["flags"]] == ["over-fragments", "digit density"]


# noise

ACCENTED = ["Hà Nội mùa thu đẹp", "quả táo đỏ rn cl 50", "plain ascii text", "", "🙂 日本 \x00\x07", "a  b", "chợ Đông"]


def keyed(mode, seed=0, texts=ACCENTED):
    return np.array([H.key_hash(f"{seed}|{mode}|{t}") for t in texts], dtype=np.int64)


@pytest.mark.parametrize("mode", N.MODES)
def test_noise_is_deterministic_and_ignores_batching(mode):
    whole = N.apply_mode(ACCENTED, mode, keyed(mode))
    assert whole == N.apply_mode(ACCENTED, mode, keyed(mode))
    alone = [N.apply_mode([t], mode, keyed(mode, texts=[t]))[0] for t in ACCENTED]
    assert whole == alone


@pytest.mark.parametrize("mode", ["drop_all", "random_drop", "tone_swap", "mixed"])
def test_diacritic_noise_leaves_ascii(mode):
    assert N.apply_mode(["plain ascii text 123"], mode, keyed(mode, texts=["x"])) == ["plain ascii text 123"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_any_text_passes_every_mode(texts):
    for mode in N.MODES:
        out = N.apply_mode(texts, mode, keyed(mode, texts=texts))
        assert len(out) == len(texts)
        if mode == "drop_all":
            assert N.drop_all(out) == out
        if mode in ("space_split", "word_merge"):
            assert [o.replace(" ", "") for o in out] == [t.replace(" ", "") for t in texts]


def test_certain_and_impossible_noise():
    one, none = np.ones(len(ACCENTED)), np.zeros(len(ACCENTED))
    h = keyed("x")
    assert N.word_merge(ACCENTED, one, h, 1) == [t.replace(" ", "") for t in ACCENTED]
    assert N.random_drop(ACCENTED, one, h, 1) == N.drop_all(ACCENTED)
    assert N.space_split(["ab c  def"], one, h, 1) == ["a b c  d e f"]
    for fn in (N.random_drop, N.tone_swap, N.space_split, N.char_confuse, N.word_merge, N.case_noise, N.homophone_swap):
        assert fn(ACCENTED, none, h, 1) == ACCENTED
    swapped = N.tone_swap(["chợ má"], one, h, 1)[0]
    assert swapped != "chợ má" and N.drop_all([swapped]) == ["cho ma"]
    assert N.char_confuse(["rn cl"], one, h, 1) == ["m d"]
    assert N.char_confuse(["m d"], one, h, 1) == ["m d"]  # one letter is never read as two
    toned = N.homophone_swap(["ma"], one, h, 1)[0]
    assert toned != "ma" and N.drop_all([toned]) == ["ma"]
    for a, b in zip("Hà Nội Ab".split(), N.case_noise(["Hà Nội Ab"], one, h, 1)[0].split()):
        assert a != b and a.lower() == b.lower()


def test_severity_is_beta_2_5():
    draws = N.beta_2_5(np.random.default_rng(0).integers(0, 2**28, 50_000), 1)
    assert draws.mean() == pytest.approx(2 / 7, abs=0.005) and draws.var() == pytest.approx(10 / 392, abs=0.001)


def test_uniforms_agree_in_spark(spark):
    df = spark.range(2000).select(H.key_hash_col(F.concat(F.lit("k"), "id")).alias("h"), "id")
    df = df.select("id", "h", H.uniform_col(F.col("h"), 3, F.col("id")).alias("u"))
    rows = df.orderBy("id").collect()
    h = np.array([H.key_hash(f"k{r['id']}") for r in rows])
    assert [r["h"] for r in rows] == h.tolist()
    assert [r["u"] for r in rows] == H.uniforms(h, 3, np.arange(2000)).tolist()


def test_noise_column_null_and_unknown(spark):
    df = spark.createDataFrame([("Hà",), (None,)], "t string")
    out = [r["v"] for r in df.select(N.noise(F.col("t"), "tone_swap").alias("v")).collect()]
    assert len(out) == 2 and None in out
    with pytest.raises(ValueError, match="unknown noise mode"):
        N.noise(F.col("t"), "nope")
    with pytest.raises(ValueError, match="positive"):
        N.variants(F.col("t"), 0)


def test_variants_cycle(spark):
    df = spark.createDataFrame([("Hà Nội mùa thu",)], "t string")
    rows = df.select(F.inline(N.variants(F.col("t"), 12))).orderBy("variant").collect()
    assert [r["mode"] for r in rows] == [*N.MODES, *N.MODES[:2]]
    short = df.select(F.inline(N.variants(F.col("t"), 4))).orderBy("variant").collect()
    assert [tuple(r) for r in short] == [tuple(r) for r in rows[:4]]


# corpus

CLEAN = ["Con mèo đen", "con  MÈO đen", "abc", "Trời hôm nay đẹp", "Straße lang", "strasse LANG", "Một hai ba"]


def strings(spark, values=CLEAN):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, text string")


def test_first_spelling_is_kept(spark):
    rows = C.first_spellings(strings(spark).repartition(4), "text", ["ord"]).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in rows] == [(0, "Con mèo đen"), (3, "Trời hôm nay đẹp"), (4, "Straße lang"), (6, "Một hai ba")]


def test_pairs(spark):
    clean = C.first_spellings(strings(spark), "text", ["ord"])
    pairs = C.contrastive_pairs(clean, hard_negatives_per_anchor=2)
    rows = pairs.collect()
    assert len(rows) == 4 * 10
    for r in rows:
        assert r["anchor_clean"] not in r["hard_negs"] and len(set(r["hard_negs"])) == 2
    assert C.contrastive_pairs(clean, k=4).count() == 16
    few = C.hard_negatives(clean, 50)
    assert few.groupBy("ord").count().where("count <> 3").count() == 0
    assert C.hard_negatives(clean.limit(1), 5).count() == 0


def test_negatives_do_not_depend_on_the_plan(spark):
    clean = strings(spark, [f"string number {i}" for i in range(50)])
    got = C.hard_negatives(clean.repartition(3), 7, seed=3)
    per = got.groupBy("ord").agg(F.countDistinct("negative").alias("n"), F.collect_set("negative").alias("s")).collect()
    assert len(per) == 50 and all(r["n"] == 7 and f"string number {r['ord']}" not in r["s"] for r in per)
    first = got.where("ord = 0").orderBy("slot").first()["negative"]
    assert first == C.hard_negatives(clean, 7, seed=3).where("ord = 0").orderBy("slot").first()["negative"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 97, 1000])
def test_keyed_permutations(spark, n):
    x = spark.range(n).select(F.col("id"), F.explode(F.array(*[F.lit(f"key{k}") for k in range(5)])).alias("k"))
    rows = x.select("id", "k", H.permuted_col(F.col("id"), H.wide_key_col(F.col("k")), n).alias("v")).collect()
    by = {k: [r["v"] for r in sorted(rows, key=lambda r: r["id"]) if r["k"] == k] for k in {r["k"] for r in rows}}
    assert all(sorted(v) == list(range(n)) for v in by.values())
    assert n < 10 or len({tuple(v) for v in by.values()}) == 5


def test_slots_of_negatives_are_independent(spark):
    n, anchors = 7, 6_000
    x = spark.range(anchors).withColumn("key", H.wide_key_col(F.concat(F.lit("k"), F.col("id").cast("string"))))
    pairs = x.select(*[H.permuted_col(F.lit(j), F.col("key"), n).alias(f"s{j}") for j in range(2)]).groupBy("s0", "s1").count().collect()
    # Every ordered pair of different places is as likely as any other.
    assert len(pairs) == n * (n - 1)
    expected = anchors / (n * (n - 1))
    assert sum((r["count"] - expected) ** 2 / expected for r in pairs) < 80  # 41 degrees of freedom


def test_a_source_that_fails_late_is_skipped(spark, tmp_path):
    good = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "ord long, text string").repartition(4)
    path = tmp_path / "late"
    good.write.parquet(str(path))
    last = sorted(path.glob("part-*"))[-1]
    last.write_bytes(last.read_bytes()[:64])
    late = lambda: spark.read.schema("ord long, text string").parquet(str(path))
    rows, used, skipped = C.union_sources([("late", late), ("good", lambda: good), ("absent", lambda: spark.read.parquet(str(tmp_path / "none")))])
    assert used == ["good"] and skipped == ["late", "absent"] and rows.count() == 400
    with pytest.raises(ZeroDivisionError):
        C.union_sources([("wrong", lambda: 1 // 0)])


def test_held_out(spark):
    training = spark.createDataFrame([("TRỜI hôm  nay đẹp",), ("STRASSE lang",)], "text string")
    clean = C.first_spellings(strings(spark), "text", ["ord"])
    assert sorted(r["ord"] for r in C.held_out(clean, training).collect()) == [0, 6]


def test_append_missing(spark):
    base, extra = strings(spark, ["b", "a", " ", "b"]), strings(spark, ["a", "c", "c"])
    rows = C.append_missing(base, extra, "text", "ord").orderBy("source", "ord").collect()
    assert [r["text"] for r in rows] == ["b", "a", "c"]


def test_row_strings(spark):
    df = spark.createDataFrame(
        [(1, "a long enough caption", ["another caption is here", "short"], "http://x y z w v u t", 3)],
        "ord long, a string, b array<string>, c string, d int",
    )
    assert [r["text"] for r in C.row_strings(df, "ord").orderBy("part").collect()] == ["a long enough caption", "another caption is here"]
    assert [r["text"] for r in C.row_strings(df, "ord", ["b"]).orderBy("part").collect()] == ["another caption is here", "short"]


def test_union_of_sources(spark):
    def broken():
        raise OSError("gone")

    rows, used, skipped = C.union_sources(
        [("bad", broken), ("one", lambda: strings(spark)), ("none", lambda: strings(spark).where("false"))]
    )
    assert used == ["one"] and skipped == ["bad", "none"] and rows.count() == len(CLEAN)
    assert C.union_sources([("bad", broken)])[0] is None


def test_source_cap_overshoots_by_a_row(spark):
    df = strings(spark, ["aaaa", "bbbb", "cccc", "dddd"])
    assert C.cap_source(df, "ord", F.char_length("text").cast("long"), 5).count() == 2


def test_json_leaves(spark):
    docs = [
        '{"key long": "value", "n": 12345, "deep": [{"a": "nested"}, ["abcd", "abc"]], "q": "say \\"hi\\" \\u00e9", "e": ""}',
        '"just a string"', "{broken", '{"a": "' + "x" * 200_000 + '"}', '{"a:": "with: colon", "b" : "spaced"}',
        '{"a": "text"} and more', '"text", "text"', "",
    ]
    got = apply(spark, string_leaves, docs)
    assert got[0] == ["value", "nested", "abcd", 'say "hi" é']
    assert got[1] == ["just a string"] and got[2] == [] and len(got[3][0]) == 200_000
    assert got[4] == ["with: colon", "spaced"] and got[5:] == [[], [], []]


# sparse search


def plain_sparse(docs, asked, terms, k):
    import math
    from collections import Counter

    tf = {d: Counter(terms(t)) for d, t in docs.items()}
    n = sum(1 for c in tf.values() if c)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log1p(n / df[t]) for t in df}
    out = {}
    for q, text in asked.items():
        c, scores = Counter(terms(text)), {}
        for d, own in tf.items():
            length = math.sqrt(sum((own[t] * idf[t]) ** 2 for t in own))
            if any(t in own for t in c):
                scores[d] = round(sum(c[t] * idf[t] * own[t] * idf[t] for t in c if t in own) / length, 9)
        for r, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:k]):
            out[q, r + 1] = (d, pytest.approx(scores[d], abs=2e-9))
    return out


@pytest.mark.parametrize("k", [1, 3, 200])
def test_sparse_search_equals_all_pairs(spark, k):
    from lanefold.operators import sparse

    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.choice([1, 2, 3, 3, 5]))) for _ in range(60)]
    docs = {i: " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.choice([1, 4, 20, 60]))) for i in range(120)}
    docs |= {500: "", 501: None, 502: "the same words", 503: "the same words", 504: "  \t\n"}
    asked = {i: docs[i] for i in range(0, 120, 7)} | {900: "nothing zzzz", 901: "", 902: "the same words and ab"}
    frame = lambda rows, key: sparse.frequencies(spark.createDataFrame(list(rows.items()), f"{key} long, text string"), key, sparse.space_words(F.col("text")))
    hits = sparse.top_k(frame(asked, "qid"), sparse.postings(frame(docs, "did")), k).collect()
    got = {(h["qid"], h["rank"]): (h["did"], h["score"]) for h in hits}
    assert len(got) == len(hits) and got == plain_sparse(docs, asked, lambda t: (t or "").split(), k)


def test_frequent_terms_need_not_find(spark):
    from lanefold.operators import sparse

    docs = [(i, f"rare{i % 40} rare{i % 40}x common often") for i in range(400)]
    rows = sparse.frequencies(spark.createDataFrame(docs, "did long, text string"), "did", sparse.space_words(F.col("text")))
    index = sparse.postings(rows)
    stats = index.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    asked = rows.where("did < 40").join(stats, "term").select(F.col("did").alias("qid"), "term", F.col("most").alias("q"), "df", "most")
    judged = sparse.essential(asked, asked.select("qid").distinct().withColumn("theta", F.lit(1.0)))
    assert {r["term"] for r in judged.where("NOT finds").collect()} == {"common", "often"}
    assert judged.where("rest >= theta").count() == 0


def test_char_grams(spark):
    from lanefold.operators import sparse

    df = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,), ("á🙂c",), ("x" * 30_000,)], "t string")
    rows = [r[0] for r in df.select(sparse.char_grams(F.col("t"), 3)).collect()]
    assert rows[:5] == [["abc", "bcd"], ["ab"], [], [], ["á🙂c"]] and len(rows[5]) == 29_998


@pytest.mark.parametrize("k, sizes", [(1, {}), (3, {}), (200, {}), (3, {"max_asked": 5}), (3, {"max_vocabulary": 2})])
@pytest.mark.parametrize("kind", ["words", "grams"])
def test_search_of_whole_texts_equals_all_pairs(spark, kind, k, sizes, monkeypatch):
    from lanefold.operators import sparse

    for name in ("UNITS_AT_ONCE", "COUNTS_AT_ONCE"):
        monkeypatch.setattr(sparse, name, 40)
    r = random.Random(4)
    words = ["".join(r.choice("abcdé🙂") for _ in range(r.choice([1, 2, 3, 3, 5]))) for _ in range(60)]
    docs = {i: " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.choice([1, 4, 20, 60]))) for i in range(120)}
    docs |= {500: "", 501: None, 502: "the same words", 503: "the same words", 504: "a", 505: "ab", 506: "a"}
    asked = {i: docs[i] for i in range(0, 120, 7)} | {900: "nothing zzzz", 901: "", 902: "the same words and ab", 903: "a", 904: None}
    terms, plain = {
        "words": (sparse.space_words, lambda t: (t or "").split()),
        "grams": (sparse.CharGrams(3), lambda t: [t[i : i + 3] for i in range(max(1, len(t) - 2))] if t else []),
    }[kind]
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    if not sizes:  # no postings are joined, nothing but hits and counts is shuffled
        monkeypatch.setattr(sparse, "postings", None)
    hits = sparse.search(frame(asked, "qid"), frame(docs, "did"), terms, k, **sizes).collect()
    got = {(h["qid"], h["rank"]): (h["did"], h["score"]) for h in hits}
    assert len(got) == len(hits) and got == plain_sparse(docs, asked, plain, k)


def test_noise_takes_a_batch_by_pieces(monkeypatch):
    import pyarrow as pa

    from lanefold.functions import noise as N

    monkeypatch.setattr(N, "PIECE_BYTES", 100)
    texts = pa.array([None, "", "x" * 40, "é" * 90, None, *["word " * 5] * 30, "z" * 500], pa.string())
    seen = []

    def work(part):
        seen.append(part.nbytes)
        return part

    assert N._by_pieces(work, texts).equals(texts) and N._by_pieces(work, texts[:0]).equals(texts[:0])
    assert len(seen) > 8 and max(seen) < 800  # one long row, or some 100 bytes and its neighbours' places


def test_pairs_by_digests_carry_no_texts(spark):
    clean = spark.createDataFrame([(i, f"text number {i} " + "é" * i) for i in range(12)], "ord long, text string")
    plain = C.contrastive_pairs(clean, k=2, hard_negatives_per_anchor=3)
    told = C.contrastive_pairs(clean, k=2, hard_negatives_per_anchor=3, told_by=F.md5)
    digests = plain.withColumn("anchor_clean", F.md5("anchor_clean")).withColumn("hard_negs", F.transform("hard_negs", lambda s: F.md5(s)))
    assert sorted(told.collect()) == sorted(digests.collect()) and told.count() == 24
