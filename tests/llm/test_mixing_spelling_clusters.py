"""Mixing, spelling variants and centroid clusters against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from lanefold.llm import drift, mixing, spelling
from lanefold.llm.common import table

MIDDLE = "/root/testdata/sf0.01"


# Mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    """Targets by source, straight from the rule: what is over three times a size is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(rows, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(map(repr, ((d, count(t)) for d, t, *_ in docs))) == sorted(repr((r.doc_id, r.size)) for r in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, text, _, source, *_ in docs:
        sizes[source] += count(text)
        largest[source] = max(largest[source], count(text))
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) * r.size <= r.taken <= -(-rate // 1) * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken, want


def test_mix_of_documents(spark):
    docs = table(spark, MIDDLE, "documents")
    rows = mixing.mixed(clashing(docs.repartition(7))).collect()
    taken, want = check_mix(rows, [tuple(r) for r in docs.collect()])
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in want)
    again = mixing.mixed(docs.orderBy("text")).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "TOGETHER", 2)
    docs = table(spark, MIDDLE, "documents").collect()
    rows = mixing.mixed(spark.createDataFrame(docs, DOCS)).collect()
    check_mix(rows, [tuple(r) for r in docs])


def test_mix_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 2)
    texts = ["one two", None, "", " \t\n", "a " * 70_000] + ["same words here"] * 9
    docs = [(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts, [None, "a", "a", "é", "zz"] + ["b"] * 9))]
    docs += [(None, "w x y z", "en", "b", 1)] * 7 + [(3, "p q", None, None, None)] * 5 + [(4, "", "en", "nothing", 0)]
    rows = mixing.mixed(spark.createDataFrame(docs, DOCS)).collect()
    check_mix(rows, docs)
    same = [r.copies for r in rows if r.doc_id is None]
    assert max(same) - min(same) <= 1
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    nothing = mixing.mixed(documents(spark, [None, ""])).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 10**6)), min_size=1, max_size=30), st.randoms())
def test_settled_but_one(items, r):
    items.sort(key=lambda x: -x[1])
    p, sizes = [x for x, _ in items], [x for _, x in items]
    mass = sum(x * s for x, s in items)
    mixing.settle(p, sizes, [r.random() for _ in p], [r.random() for _ in p])
    assert sum(mixing._open(x) for x in p) <= 1 and all(0 <= x <= 1 for x in p)
    assert sum(x * s for x, s in zip(p, sizes)) == pytest.approx(mass, rel=1e-9)


def test_expectations_stay():
    r, start, sizes = random.Random(3), [0.3, 0.6, 0.5, 0.9, 0.2], [50, 30, 20, 5, 1]
    total, n = np.zeros(5), 20_000
    for _ in range(n):
        p = list(start)
        mixing.settle(p, sizes, [r.random() for _ in p], [r.random() for _ in p])
        total += p
    assert np.abs(total / n - start).max() < 0.02


# Spelling


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words, form = plain_words(docs), {}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants_of(df):
    rows = spelling.variants(df).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("letters", ["ab", "aé×z", "abcdefgh"])
def test_variants_against_all_pairs(spark, letters, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    r = random.Random(letters)
    docs = [(i, " ".join("".join(r.choice(letters) for _ in range(r.choice([4, 5, 5, 6, 6, 7]))) for _ in range(200))) for i in range(25)]
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS)
    assert variants_of(clashing(df)) == plain_variants(docs)


def test_variants_of_odd_texts(spark):
    long = "aaaaa" * 60_000
    texts = [None, "", "12 3_4", "Straße STRASSE straße straße", "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü", "hello helo helloıhello hellо", *[f"{long} {long}b"] * 3]
    docs = list(enumerate(texts)) + [(None, "colour color colour colour color color colouur")] * 4 + [(2, "kleine kleines kleine")] * 5
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS)
    got, want = variants_of(df), plain_words(docs)
    assert {(w, n) for w, _, _, n, _, _ in got} == set(want.items())
    near = {g[0]: g[1:] for g in got}
    assert near["colouur"][:2] == ("colour", "colour") and near["colour"][0] is None and near["color"][3] == 1
    assert near[long][3] == 1 and near[long + "b"][3] == 1
    assert near["kleines"][:2] == ("kleine", "kleine")
    assert variants_of(spark.createDataFrame([], DOCS)) == set()


def test_text_longer_than_a_mebibyte(spark):
    words = ["alpha", "alphas", "beta", "gamma", "gammä", "delta"]
    text = " ".join(random.Random(1).choice(words) for _ in range(250_000))
    assert variants_of(documents(spark, [text], first=5)) == plain_variants([(5, text)])


# Clusters

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, np.array([int(np.floor(1024 * x)) for x in e], dtype=object)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    centroids = [c for _, c in seeds]
    for t in range(rounds + 1):
        each = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids)) for _, v in kept]
        if t == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, each) if m == j]
            if own:
                centroids[j] = sum(own) // len(own)
    sums = Counter()
    for d, j in each:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, j, d, sums[j], sum(sums.values()), sha[j])) for (i, _), (d, j) in zip(kept, each))


def clusters_of(df):
    return sorted(repr(tuple(r)) for r in drift.clustered(df).collect())


def blobs(n, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 64))
    return [(int(i), (centres[i % 6] + spread * r.normal(size=64)).tolist()) for i in range(n)]


def test_clusters_against_plain_rounds(spark):
    from pyspark.sql import functions as F

    for rows in (blobs(300, 1), blobs(150, 2, 0.8)):
        df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
        assert clusters_of(df.withColumns({c: F.lit(1) for c in ("cluster", "v", "lower", "part", "totals")})) == plain_clusters(rows)


def test_bounds_spare_scans(spark):
    df = spark.createDataFrame([(*r, 0) for r in blobs(2_000, 3, 0.02)], VECTORS).repartition(3)
    found = drift.clusters(df)
    assert found.scanned[0] == 2_000 and sum(found.sizes) == 2_000
    assert sum(found.scanned[1:]) < 0.5 * 2_000 * (len(found.scanned) - 1)


def test_clusters_of_odd_vectors(spark):
    one = [0.25] * 64
    rows = [(1, one)] * 5 + [(None, one), (2, None), (3, []), (4, one[:63]), (5, one + [1.0]), (6, one[:-1] + [None]), (7, one[:-1] + [float("nan")]), (8, one[:-1] + [float("inf")])]
    rows += [(9, [-0.0001] * 64), (10, [1e-320] * 64), (11, [1000.5] * 64)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    assert clusters_of(df) == plain_clusters(rows)
    assert clusters_of(spark.createDataFrame([(1, [1e200] * 64, 0), (2, None, 0)], VECTORS)) == []
    assert clusters_of(spark.createDataFrame([], VECTORS)) == []
    large = [(i, [((-1) ** (i * j)) * 131_000.0 + i for j in range(64)]) for i in range(12)]
    assert clusters_of(spark.createDataFrame([(*r, 0) for r in large], VECTORS)) == plain_clusters(large)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([2, 3, 8]), st.floats(0.01, 20))
def test_loosening_holds_for_every_point(seed, d, size):
    r = np.random.default_rng(seed)
    centre, old = r.normal(size=d), 3 * r.normal(size=d)
    new, radius = old + size * r.normal(size=d), size * r.random()
    bound = drift.loosening(centre, radius, old, new)
    assert bound <= np.linalg.norm(new - old) + 1e-9
    step = r.normal(size=(500, d))
    x = centre + radius * step / np.linalg.norm(step, axis=1, keepdims=True) * r.random((500, 1)) ** 0.2
    nearer = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
    assert nearer.max() <= bound + 1e-9
