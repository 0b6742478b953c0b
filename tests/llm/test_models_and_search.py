"""Language, toxicity and vector search against brute force and held-out rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, clashing, documents, words
from pyspark.sql import functions as F

from lanefold.llm import collisions, common, langid, substrings, toxicity
from lanefold.llm.common import held_out, table

LABELS = "doc_id long, quality int, toxic int"


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", held_out(F.col("doc_id")))
    for r in df.collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


# Language


@pytest.fixture(scope="module")
def spoken(spark):
    texts = [(" ".join(words(40, i, "abcde")), "x") for i in range(60)] + [(" ".join(words(40, i, "defgh")), "y") for i in range(60)]
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(texts)]
    rows += [(200, None, "x", "s", 1), (201, "", "y", "s", 1), (202, "12 !? 34", "x", "s", 1), (203, "abc abc", None, "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_code_lengths_are_those_of_a_plain_context_tree(spoken):
    counts = langid.fit(spoken)
    assert counts.languages == ["x", "y"]
    tables = langid.Tables(counts)
    p = np.exp2(-tables.bits.astype(np.float64)).reshape(-1, tables.s, 2)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    learnt = [r for r in spoken.collect() if r.doc_id is not None and r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    symbols = sorted({b for r in learnt for b in r.text.encode()})
    size = len(symbols) + 1

    def plain(context, symbol, texts):
        """Probability by prediction by partial matching, straight from the texts."""
        p = {s: 1 / size for s in [0, *symbols]}
        for order in range(langid.ORDER + 1):
            seen = {}
            for t in texts:
                padded = b"\0" * langid.ORDER + t
                for i in range(langid.ORDER, len(padded)):
                    if padded[i - order : i] == context[len(context) - order :]:
                        seen[padded[i]] = seen.get(padded[i], 0) + 1
            n, u = sum(seen.values()), len(seen)
            if n:
                free = sum(v for s, v in p.items() if s not in seen)
                escape = u if free > 0 else 0
                p = {s: seen[s] / (n + escape) if s in seen else escape / (n + escape) * v / free for s, v in p.items()}
        return p[symbol if symbol in symbols else 0]

    text = b"abcz dae"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for j, lang in enumerate(counts.languages):
        texts = [r.text.encode() for r in learnt if r.lang == lang]
        padded = b"\0" * langid.ORDER + bytes(b if b in symbols else 0 for b in text)
        want = sum(-np.log2(plain(padded[i : i + langid.ORDER], padded[i + langid.ORDER], texts)) for i in range(len(text)))
        assert tables.lengths(data, offsets)[0, j] == pytest.approx(want, rel=1e-5)
    both = np.frombuffer(text + b"ab" + text, np.uint8)
    lengths = tables.lengths(both, np.array([0, 8, 8, 10, 18]))
    assert np.allclose(lengths[0], lengths[3]) and (lengths[1] == 0).all()


def test_languages_of_documents(spark, spoken):
    rows = langid.identify(clashing(spoken)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == spoken.count()
    assert all(got[i].lang_pred == ("x" if i < 60 else "y") for i in range(120))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert all(0 <= r.score <= 1 for r in rows)
    hidden = spoken.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(hidden).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in rows}
    nothing = langid.identify(spoken.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_languages_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_code_lengths_hold_a_stretch_of_a_long_text(spoken, monkeypatch):
    counts = langid.fit(spoken)
    tables = langid.Tables(counts)
    rng = np.random.default_rng(5)
    sizes = [0, 3, 0, 200, 1, 2, 61, 0, 33, 0]
    offsets = np.append(0, np.cumsum(sizes))
    data = rng.choice(np.frombuffer(b"abcdefgh z", np.uint8), offsets[-1])
    each = np.concatenate([tables.lengths(data[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:])])
    for stretch in (1, 2, 3, 5, 64, 1000):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert np.allclose(tables.lengths(data, offsets), each, rtol=1e-12, atol=0)
    monkeypatch.setattr(langid, "CONTEXTS", 7)
    assert (langid.Tables(counts).bits == tables.bits).all()
    monkeypatch.undo()
    data = np.resize(data, 4 << 20)
    tracemalloc.start()
    tables.lengths(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20


def test_steps_without_a_model_drop_those_of_earlier_steps():
    common.resident("model", lambda: np.zeros(9))
    toxicity.hashes_of(["some words"])
    assert list(substrings._adjoined(iter([]))) == []
    assert not common._resident and not toxicity._hashes


# Toxicity


def test_words_are_counted_and_tallied_by_one_worker_a_task(spark):
    docs = documents(spark, ["a b b", "b c", "", None])
    words = np.unique(toxicity.hashes_of(["a b x"])[1])
    plan = toxicity.tallies(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    found, total = toxicity.document_frequencies(docs, words)
    of = dict(zip(words.tolist(), found.tolist()))
    assert [of[int(toxicity.hashes_of([w])[1][0])] for w in "abx"] == [1, 2, 0] and total == 4
    again = toxicity.document_frequencies(docs, words, toxicity.known_terms(docs, words))
    assert (again[0] == found).all() and again[1] == total


@pytest.fixture(scope="module")
def labelled(spark):
    texts, marks = [], []
    for i in range(400):
        w = words(60, i)
        toxic = i % 4 == 0
        if toxic:
            w[i % 50] = "zzvilest"
            w[(i * 7) % 50] = ("grobian", "Zzvile", "zzviler")[i % 3]
        texts.append(" ".join(w) + ".")
        marks.append((i, 1, int(toxic)))
    texts += [None, "", "zzvilest!", "ok " * 3_000 + "zzvilest"]
    marks += [(0, 1, 1), (4_000, 1, 1), (None, 1, 1), (5, 1, None)]
    return documents(spark, texts), spark.createDataFrame(marks, LABELS)


def test_neighbours_are_exact(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, labels)
    texts = {r.doc_id: Counter(re.findall(r"[a-z]+", (r.text or "").lower())) for r in docs.collect()}
    marks = {i: int(i % 4 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(index.ids.tolist()) == sorted(marks) and len(marks) > 2 * toxicity.BLOCK
    df = Counter(w for t in texts.values() for w in t)
    p, n = (Counter(w for i, m in marks.items() if m == c for w in texts[i]) for c in (1, 0))
    size = Counter(marks.values())
    weight = {
        w: (math.log((1 + len(texts)) / (1 + df[w])) + 1) * math.log2(2 + (p[w] / size[1]) / (max(n[w], 1) / size[0])) ** 2
        for w in p | n
    }

    def unit(text):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in text.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(texts[i]) for i in marks}
    for i in [*range(0, 400, 7), 402, 403]:
        text = unit(texts[i])
        cosines = {j: sum(x * v.get(w, 0.0) for w, x in text.items()) for j, v in vectors.items()}
        _, names, counts = toxicity.hashes_of([" ".join(texts[i].elements())])
        at, values = toxicity.weighted(index, names, counts)
        rows, found = toxicity.nearest(index, at, values)
        best = sorted((c for c in cosines.values() if c > 1e-11), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(found, best, atol=1e-9) and np.allclose(found, [cosines[j] for j in index.ids[rows].tolist()], atol=1e-9)
        order = list(zip((-found).tolist(), index.ids[rows].tolist()))
        assert order == sorted(order)
        if i in marks:
            row = index.ids.tolist().index(i)
            assert row not in toxicity.nearest(index, at, values, skip=row)[0]


def test_words_of_long_texts(monkeypatch):
    text = "One two, THREE " * 50 + "x" * 300 + " " + "Ärger 12drei"
    whole = toxicity.hashes_of([text, "", "one"])
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 40)
    assert all((a == b).all() for a, b in zip(*(map(lambda f: np.array(sorted(zip(*map(np.ndarray.tolist, f)))), (whole, toxicity.hashes_of([text, "", "one"]))))))
    assert sum(whole[2]) == 150 + 1 + 2 + 1 and set(whole[0].tolist()) == {0, 2}


def test_toxic_documents(spark, labelled):
    docs, labels = labelled
    rows = toxicity.judge(clashing(docs), clashing(labels)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(400)) >= 396
    assert [got[i].predicted for i in (400, 401, 402, 403)] == [0, 0, 1, 1]
    assert got[402].evidence and all(e.doc_id % 4 == 0 for e in got[402].evidence)
    assert all(got[i].evidence for i in range(400)) and not got[401].evidence
    hidden = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), F.lit(1)).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.judge(docs, hidden).collect()} == {(r.doc_id, r.score) for r in rows}
    none = toxicity.judge(docs, labels.withColumn("toxic", F.lit(0))).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    assert toxicity.judge(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_monotone_steps():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert y.tolist() == [0.0, 0.5, 1.0] and (np.diff(x) > 0).all()


# Vectors


def brute(rows, k=20, every=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted(((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_of_all_queries(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 150)
    monkeypatch.setattr(collisions, "CHUNK", 10)
    r = np.random.default_rng(0)
    vectors = [v.tolist() for v in r.standard_normal((600, 8)) * r.uniform(0.2, 3, (600, 1))]
    vectors[40] = vectors[41] = vectors[42]
    rows = list(enumerate(vectors)) + [
        (1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [1.0] * 6), (1060, [float("nan")] * 8),
        (1080, [float("inf")] + [1.0] * 7), (1100, [1.0] * 5), (None, [1.0] * 8), (7, vectors[7]),
    ]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in collisions.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        scores = {i: s for i, s in brute(rows, k=10_000)[q]} if q < 40 else dict(want[q])
        assert all(scores[i] == s for _, i, s in found if i in scores)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in collisions.nearest_vectors(df).orderBy("rank").collect()] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert collisions.nearest_vectors(df.where("vec_id = 3")).count() == 0
    assert collisions.nearest_vectors(df.limit(0)).count() == 0
    assert collisions.nearest_vectors(df.where("vec_id = 0")).count() == 0


def test_windows_meet_no_entry_twice():
    vectors = np.random.default_rng(3).standard_normal((2_000, 16))
    index = collisions.SortedArrays(np.arange(2_000), vectors)
    found = list(index.search(np.arange(20), vectors[:20], 20))
    assert index.touched < 0.75 * 20 * index.order.size  # of all entries for each query
    hits = 0
    for query_id, ids, _ in found:
        scores = vectors @ vectors[query_id]
        scores[query_id] = -np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 20


def test_first_windows_are_counted_by_stretches(monkeypatch):
    vectors = np.random.default_rng(4).standard_normal((2_000, 16))
    index, met, bincount = collisions.SortedArrays(np.arange(2_000), vectors), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, **options: (met.append(len(x)), bincount(x, **options))[1])
    list(index.search(np.arange(20), vectors[:20], 20))
    assert sum(met) < 0.3 * 20 * index.order.size  # one by one; most of the 0.6 in windows in whole stretches
    r = np.random.default_rng(5)
    ends = np.sort(r.integers(0, 2_001, (2, len(index.order))), axis=0)
    ends[1, :30] = np.minimum(ends[0, :30] + r.integers(0, 70, 30), 2_000)
    lo, hi = ends.tolist()
    left, right, count = index.stretches(lo, hi)
    count = count.astype(np.int64)
    for row, a, b, c, d in zip(index.order, lo, left, right, hi):
        assert a <= b <= c <= d and b - a <= 69 and d - c < 64
        count[row[a:b]] += 1
        count[row[c:d]] += 1
    plain = sum(bincount(row[a:d], minlength=2_000) for row, a, d in zip(index.order, lo, hi))
    assert (count == plain).all()


def test_very_large_and_small_components(spark):
    sizes = [1e200, 1e-200, 1.0, 1e154, -1e200, 5e-324]
    rows = [(20 * i, [x, x / 2]) for i, x in enumerate(sizes)] + [(1, [1e200, -1e200])]
    got = {}
    for r in collisions.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, v in rows[:-1]:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = [(i, float((np.array(v) * np.array(w)).sum())) for i, w in rows if i != q]
        scores = [(i, -math.inf if math.isnan(s) else s) for i, s in scores]
        assert got[q] == sorted(scores, key=lambda x: (-x[1], x[0]))


def test_recall_on_the_table(spark):
    data = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    v, ids = np.array([x for _, x in rows], float), np.array([i for i, _ in rows])
    hits = 0
    found = collisions.nearest_vectors(data).collect()
    for q in ids[ids % 20 == 0]:
        s = (v * v[ids == q]).sum(axis=1)
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits += len(set(best) & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * len(found)
