"""Fingerprints, components and repeated passages against brute force."""

import random

import numpy as np
import xxhash
from helpers import DOCS, SMALL, clashing, documents, words
from pyspark.sql import functions as F

from lanefold.llm import graph, simhash, substrings
from lanefold.llm.common import table


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(values, bits=2):
    """Least index reachable from each value."""
    low = list(range(len(values)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= bits and low[j] < low[i]:
                    low[i], moved = low[j], True
    return low


def test_golay_code_is_perfect_and_replicas_meet():
    code = simhash.golay()
    assert len(set(code.syndrome(np.concatenate([code._words(w) for w in range(4)])).tolist())) == 2048
    r = np.random.default_rng(3)
    x = r.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, size=i % 3, replace=False):
            y[i] ^= np.uint64(1 << int(b)).astype(np.int64)
    homes = next(a for _, a, home in simhash.replicas(x) if home)
    near = [set() for _ in y]
    for row, anchor, _ in simhash.replicas(y):
        for i, a in zip(row.tolist(), anchor.tolist()):
            near[i].add(a)
    assert all(h in n for h, n in zip(homes.tolist(), near))


def test_links_of_crowded_and_lonely_fingerprints(spark, monkeypatch):
    r = random.Random(8)
    centre = r.getrandbits(64)
    values = {centre, 0, 3, 7}
    for _ in range(60):  # one crowd
        values.add(centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (2**64 - 1))
    while len(values) < 140:
        values.add(r.getrandbits(64))
    values = sorted(values)
    low = linked(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long").repartition(4)
    assert_same(values, low, simhash.links(df))
    members = np.sort(np.array(values, dtype=np.uint64).astype(np.int64))
    few = sorted(zip(*[x.tolist() for x in map(np.concatenate, zip(*simhash._near(members, members)))]))
    monkeypatch.setattr(simhash, "FEW_MEMBERS", 10)
    many = sorted(zip(*[x.tolist() for x in map(np.concatenate, zip(*simhash._near(members, members)))]))
    assert set(few) == set(many) | {(i, i) for i in range(len(members))}


def assert_same(values, low, edges):
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    groups = {}
    for v, k in zip(signed, low):
        groups.setdefault(k, []).append(v)
    for members in groups.values():
        if len(members) > 1:
            assert {roots[m] for m in members} == {min(members)}
        else:
            assert members[0] not in roots


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (None, 5), (201, 200)]
    df = spark.createDataFrame(chain, "u long, v long").repartition(5)
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert graph.components(df.limit(0)).count() == 0


def test_grouped_documents(spark):
    base = words(300, 1)
    near = [*base]
    near[150] = "changed"
    texts = [None, "", " \n", "One two", "one TWO", " ".join(base), " ".join(near), "\t".join(base).upper(), " ".join(words(80, 2)), "É é"]
    rows = simhash.grouped(clashing(documents(spark, texts)).repartition(3)).collect()
    got = {r.doc_id: r for r in rows}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == linked(fps)
    assert got[0].component_id == got[2].component_id == 0 and got[7].component_id == 5
    twice = documents(spark, ["a b c", "a b c"]).unionAll(documents(spark, ["a b c"]))
    assert [(r.doc_id, r.component_id) for r in simhash.grouped(twice).orderBy("doc_id").collect()] == [(0, 0), (0, 0), (1, 0)]
    assert simhash.grouped(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_small_table(spark):
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id: r for r in simhash.grouped(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    low = linked(fps)
    assert all(got[d].component_id == rows[k][0] for (d, _), k in zip(rows, low))


def test_gear_hash_rolls_and_chunks_resist_shifts():
    parts = [b"hello world " * 30, b"", "aé漢字 ".encode() * 50, b"x" * 900]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    rolled = []
    for p in parts:
        h = 0
        for b in p:
            h = ((h << 1) + int(substrings.GEAR[b])) & 0xFFFFFFFF
            rolled.append(h)
    assert substrings.gear_hashes(data, offsets).tolist() == rolled
    ends = substrings.chunk_ends(data, offsets)
    sizes = np.diff(np.append(0, ends))
    assert ends[-1] == len(data) and sizes.max() <= substrings.MAX_CHUNK and set(offsets[1:]) <= set(ends.tolist())
    for e in ends.tolist():
        b"".join(parts)[:e].decode()
    text = " ".join(words(2_000, 4)).encode()

    def chunked(x):
        e = substrings.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        return {x[a:b] for a, b in zip([0, *e[:-1].tolist()], e.tolist())}

    before, after = chunked(text), chunked(b"an insertion " + text[:5_000] + b" and another " + text[5_000:])
    assert len(before - after) <= 8 < len(before)


def test_repeated_passages_go_and_clean_texts_stay(spark):
    passage = " ".join(words(60, 9))
    own = [" ".join(words(120, s)) for s in range(20, 26)]
    texts = [
        own[0] + " " + passage + " " + own[1], own[2], passage + " " + own[3], own[4] + " " + passage,
        own[5], None, "", "ha " * 200, own[5] + " tail", "漢" * 400, own[4][:300] + " " + "漢" * 400,
    ]
    df = clashing(documents(spark, texts)).repartition(4)
    out = {r.doc_id: r for r in substrings.deduplicated(df).collect()}
    assert len(out) == len(texts) and out[0].score == "x"
    for i in (0, 1, 4, 5, 6, 7, 9):  # first holders, and what nobody else has
        assert out[i].text == texts[i] and out[i].removed_chars == 0 and out[i].kept_in == []
    for i, rest in ((2, own[3]), (3, own[4])):
        assert out[i].kept_in == [0] and out[i].removed_chars > 0.6 * len(passage)
        assert rest in out[i].text
        assert set(out[i].text.split()) <= set(texts[i].split())  # whole words go
    assert out[8].kept_in == [4] and out[8].text.endswith("tail")
    assert "漢" * 300 not in out[10].text
    for r in out.values():
        gone = sum(s.end - s.start for s in r.removed_spans)
        assert gone == r.removed_chars and len(texts[r.doc_id] or "") - gone == len(r.text or "")
    assert {r.doc_id for r in substrings.shortened(df).collect()} == {2, 3, 8, 10}
    assert substrings.shortened(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_ids_and_missing_ids(spark):
    text = " ".join(words(150, 31))
    df = spark.createDataFrame([(1, text), (1, text), (1, "x " + text), (None, text), (2, text)], "doc_id long, text string")
    out = [(r.doc_id, len(r.text)) for r in substrings.deduplicated(df).collect()]
    assert sorted(n for d, n in out if d == 1) == [len(text), len(text), len(text) + 2]
    assert [n for d, n in out if d is None] == [len(text)]
    assert [n for d, n in out if d == 2] == [0]
    assert substrings.deduplicated(df.where(F.lit(False))).count() == 0


def test_short_worded_passages_go_whole(spark):
    import random

    r = random.Random(5)
    short = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 5))) for _ in range(51 * 60)]
    passages = [" ".join(short[51 * i : 51 * i + 51]) for i in range(60)]
    frame = lambda seed, p: " ".join(words(40, seed)) + " " + p + " " + " ".join(words(40, seed + 500))
    texts = [frame(1_000 + 2 * i, p) for i, p in enumerate(passages)] + [frame(3_001 + 2 * i, p) for i, p in enumerate(passages)]
    out = {x.doc_id: x for x in substrings.deduplicated(documents(spark, texts)).collect()}
    assert all(out[i].text == texts[i] for i in range(60))
    for i, p in enumerate(passages):
        left = texts[60 + i].replace(p, "")
        kept = out[60 + i].text
        assert set(left.split()) <= set(kept.split()) and len(kept.split()) <= len(left.split()) + 2
        assert out[60 + i].kept_in == [i]


def test_disk_holds_one_step_at_a_time(spark):
    import os
    import time

    from lanefold.llm.common import CLEANUP, stored

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [d.getPath() for d in manager.localDirs()]
    shuffled = lambda: {f for t in tops for _, _, names in os.walk(t) for f in names if f.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    rows = stored(spark.range(1_000).groupBy((F.col("id") % 50).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(CLEANUP, None) == setting
    assert rows.count() == 50 and {r["count"] for r in rows.collect()} == {20}

    # The texts are shuffled beside the passages alone, and not beside what these are made from.
    passage = " ".join(words(60, 9))
    texts = [passage + " " + " ".join(words(120, s)) for s in range(3)]
    plan = substrings.deduplicated(documents(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2 and plan.count("Join ") <= 1


def test_runs_grow_as_far_as_their_holder_agrees():
    words_ = "one two three four five six seven".encode()
    at = words_.index(b"four")
    met = dict(start=at, end=at + 4, ids=[1], before=b"xx two three ", after=b" five six s")
    assert substrings.grown([met], words_) == [(words_.index(b" two"), len(words_) - 4, {1})]
    assert substrings.runs([met], words_, min_words=5) == [(words_.index(b"two"), words_.index(b" seven"), {1})]
    assert substrings.runs([met], words_, min_words=6) == [] == substrings.runs([], b"")
