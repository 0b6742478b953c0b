"""Search against brute force, in every physical form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanefold.operators import cells, fusion, search

RNG = np.random.default_rng(5)
N, DIM, NQ = 300, 8, 7


def unit(matrix):
    return (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)


DOCS = unit(RNG.standard_normal((N, DIM)))
DOCS[100:200] = DOCS[7]  # a third of the documents are copies of one
ASKED = unit(RNG.standard_normal((NQ, DIM)))
ASKED[0] = DOCS[7]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:04d}", f"v{i % 3}", DOCS[i].tolist()) for i in range(N)]
    return spark.createDataFrame(rows, "pk string, video_id string, vec array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q, ASKED[q].astype(float).tolist()) for q in range(NQ)], "qid long, qvec array<double>")


def brute(k, keep=lambda i: True):
    out = {}
    scores = np.round(ASKED.astype(float) @ DOCS.astype(float).T, 12)
    for q in range(NQ):
        order = sorted((i for i in range(N) if keep(i)), key=lambda i: (-scores[q, i], i))[:k]
        out[q] = [f"d{i:04d}" for i in order]
    return out


def lists(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["pk"])
    return out


@pytest.mark.parametrize("k", [1, 5, 120])
def test_scan_equals_brute_force(docs, queries, k):
    hits = search.top_k(docs, queries, k, carry=("video_id",))
    assert lists(hits) == brute(k)
    ranks = [r["rank"] for r in hits.where("qid = 3").orderBy("rank").collect()]
    assert ranks == list(range(1, k + 1))


def test_cells_of_blocks_equal_brute_force(docs, queries):
    hits = search.top_k(docs, queries, 6, max_broadcast_queries=2, docs_per_cell=40)
    assert lists(hits) == brute(6)


def test_many_equal_scores_are_ordered_by_key(docs, queries):
    assert lists(search.top_k(docs, queries, 50))[0][:2] == ["d0007", "d0100"]


def test_filter_applies_before_ranking(docs, queries):
    where = search.filter_sql('video_id == "v1" and not (pk == "d0001")', docs.columns)
    got = lists(search.top_k(docs, queries, 4, where=where))
    assert got == brute(4, lambda i: i % 3 == 1 and i != 1)


def test_more_hits_than_documents(docs, queries):
    few = docs.where("pk < 'd0004'")
    assert all(len(v) == 4 for v in lists(search.top_k(few, queries, 100)).values())
    assert search.top_k(docs.where("false"), queries, 3).count() == 0
    assert search.top_k(docs, queries.where("false"), 3).count() == 0


def test_self_query_is_first(docs, spark):
    own = docs.where("pk = 'd0042'").select(F.lit(1).cast("long").alias("qid"), F.col("vec").alias("qvec"))
    top = search.top_k(docs, own, 1, dim=DIM).first()
    assert top["pk"] == "d0042" and abs(top["score"] - 1) < 1e-3


def test_errors(docs, queries, spark):
    with pytest.raises(ValueError, match="positive"):
        search.top_k(docs, queries, 0)
    with pytest.raises(ValueError, match="unknown vector column"):
        search.top_k(docs, queries, 1, vec="nope")
    with pytest.raises(ValueError, match="dim mismatch"):
        search.top_k(docs, queries, 1, dim=16)
    wide = spark.createDataFrame([(1, [1.0] * 16)], "qid long, qvec array<double>")
    with pytest.raises(Exception, match="dim mismatch"):
        search.top_k(docs, wide, 1).collect()
    for bad in ("pk == 'a'; drop", "other == 1", "pk == pk()", "1 + 1"):
        with pytest.raises(ValueError):
            search.filter_sql(bad, ["pk"])
    assert search.filter_sql('pk == "it\'s" or pk in ["a", "b"]', ["pk"]) == "`pk` = 'it\\'s' OR `pk` IN ( 'a' , 'b' )"


def maxsim(q, d):
    return float(np.mean([max(float(np.dot(a, b)) for b in d) for a in q])) if len(d) else 0.0


@pytest.mark.parametrize("limit", [100, 2])
def test_late_interaction_over_ragged_tokens(spark, limit):
    rng = np.random.default_rng(2)
    texts = [unit(rng.standard_normal((int(n), 4))) if n else np.zeros((0, 4)) for n in rng.integers(0, 6, 40)]
    asked = [unit(rng.standard_normal((int(n), 4))) for n in rng.integers(1, 5, 5)]
    d = spark.createDataFrame([(i, [t.tolist() for t in x]) for i, x in enumerate(texts)], "pk long, vec array<array<float>>")
    q = spark.createDataFrame([(i, [t.astype(float).tolist() for t in x]) for i, x in enumerate(asked)], "qid long, qvec array<array<double>>")
    hits = search.top_k(d.repartition(3), q, 3, scorer="late_interaction", max_broadcast_queries=limit, docs_per_cell=7)
    for r in hits.collect():
        assert r["score"] == pytest.approx(maxsim(asked[r["qid"]], texts[r["pk"]]), abs=1e-6)
    for i, x in enumerate(asked):
        best = sorted(range(40), key=lambda j: (-round(maxsim(x, texts[j]), 9), j))[:3]
        assert [r["pk"] for r in hits.where(F.col("qid") == i).orderBy("rank").collect()] == best


def test_late_interaction_known_value(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "qid long, qvec array<array<double>>")
    d = spark.createDataFrame([(1, [[1.0, 0.0], [0.6, 0.8]])], "pk long, vec array<array<float>>")
    assert search.top_k(d, q, 1, scorer="late_interaction").first()["score"] == pytest.approx(0.9)


@pytest.fixture(scope="module")
def centroids(spark):
    return spark.createDataFrame([(i, DOCS[i * 11].astype(float).tolist()) for i in range(6)], "cell long, vec array<double>")


def test_probing_all_cells_is_exact(docs, queries, centroids):
    index = cells.assign_cells(docs, centroids)
    assert lists(cells.probe_search(index, centroids, queries, 5, probes=6)) == brute(5)


def test_probing_few_cells_reads_only_those(docs, queries, centroids, monkeypatch):
    index = cells.assign_cells(docs, centroids).cache()
    got = cells.probe_search(index, centroids, queries, 5, probes=2)
    near = np.argsort(-(ASKED.astype(float) @ DOCS[[i * 11 for i in range(6)]].astype(float).T), axis=1)[:, :2]
    where = {r["pk"]: r["cell"] for r in index.select("pk", "cell").collect()}
    want = {}
    scores = np.round(ASKED.astype(float) @ DOCS.astype(float).T, 12)
    for q in range(NQ):
        inside = [i for i in range(N) if where[f"d{i:04d}"] in near[q]]
        want[q] = [f"d{i:04d}" for i in sorted(inside, key=lambda i: (-scores[q, i], i))[:5]]
    assert lists(got) == want
    monkeypatch.setattr(cells, "MAX_QUERIES", 4)
    assert lists(cells.probe_search(index, centroids, queries, 5, probes=2)) == want


def test_recall(docs, queries, centroids):
    exact = search.top_k(docs, queries, 5)
    full = cells.recall_against_exact(exact, exact, 5).collect()
    assert all(r["recall_set"] == r["recall_score"] == 1.0 for r in full) and len(full) == NQ
    none = cells.recall_against_exact(exact.where("qid > 2"), exact, 5)
    assert none.where("recall_set = 0").count() == 3
    # near-duplicates at the cut: other copies of the same vector count by score, not by id
    shifted = exact.where("qid = 0").withColumn("pk", F.concat(F.lit("x"), "pk"))
    row = cells.recall_against_exact(shifted, exact.where("qid = 0"), 5).first()
    assert row["recall_set"] == 0.0 and row["recall_score"] == 1.0


def test_refined_centroids_are_unit(docs, centroids):
    out = cells.refine_centroids(docs, centroids, rounds=2).collect()
    assert all(np.linalg.norm(r["vec"]) == pytest.approx(1.0) for r in out)


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, pk string, lane string, score double, rank long")


def test_fusion(spark):
    rows = [(1, "a", "x", 0.9, 1), (1, "b", "x", 0.8, 2), (1, "b", "y", 0.7, 1), (1, "c", "y", 0.6, 2), (2, "a", "x", 0.5, 1)]
    out = fusion.reciprocal_rank_fusion(hits(spark, rows), 8, 60).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["pk"]) for r in out] == [(1, "b"), (1, "a"), (1, "c"), (2, "a")]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and out[0]["per_lane"] == {"x": 0.8, "y": 0.7}
    assert [r["pk"] for r in fusion.reciprocal_rank_fusion(hits(spark, rows), 1).where("qid = 1").collect()] == ["b"]


def test_fusion_ties_by_key_and_errors(spark):
    rows = [(1, "z", "x", 0.9, 1), (1, "a", "y", 0.1, 1)]
    assert [r["pk"] for r in fusion.reciprocal_rank_fusion(hits(spark, rows), 5).orderBy("rank").collect()] == ["a", "z"]
    for kwargs in ({"rrf_k": 0, "top_k": 1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            fusion.reciprocal_rank_fusion(hits(spark, rows), **kwargs)


def test_submissions_are_ranked_again(spark):
    rows = [(1, "a", "x", 0.9, 2), (1, "b", "x", 0.8, 5)]
    out = fusion.to_submissions(hits(spark, rows)).orderBy("rank").collect()
    assert [(r["rank"], r["frame_id"]) for r in out] == [(1, "a"), (2, "b")]


# Pivots and the stored index

from lanefold.operators import pivots  # noqa: E402
from lanefold.sinks import tables  # noqa: E402


def table_of(spark, vectors, keys=None):
    rows = [(keys[i] if keys else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "pk long, vec array<double>").repartition(3)


def asked_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, qvec array<double>")


def best_pairs(docs, asked, k):
    scores = np.round(np.asarray(asked) @ np.asarray(docs).T, 12)
    return {(q, int(i), r + 1) for q in range(len(asked)) for r, i in enumerate(sorted(range(len(docs)), key=lambda i: (-scores[q, i], i))[:k])}


def found_pairs(hits):
    rows = hits.collect()
    out = {(r["qid"], r["pk"], r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("kind", ["blobs", "norms", "copies", "flat"])
def test_nearest_join_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    docs = rng.normal(size=(260, 6))
    if kind == "blobs":
        docs = rng.normal(size=(9, 6))[rng.integers(0, 9, 260)] * 5 + 0.1 * docs
    elif kind == "norms":
        docs *= rng.exponential(size=(260, 1)) ** 3
    elif kind == "copies":
        docs[40:200] = docs[3]
    else:
        docs[:] = 0
    asked = np.concatenate([docs[:50], rng.normal(size=(20, 6)), np.zeros((1, 6))])
    hits = pivots.nearest_join(table_of(spark, docs), asked_of(spark, asked), 4, docs_per_group=50, queries_per_group=9)
    assert found_pairs(hits) == best_pairs(docs, asked, 4)


def test_nearest_join_of_few_and_none(spark):
    docs, asked = table_of(spark, np.eye(3)), asked_of(spark, np.eye(3)[:2])
    assert found_pairs(pivots.nearest_join(docs, asked, 10)) == best_pairs(np.eye(3), np.eye(3)[:2], 10)
    assert pivots.nearest_join(docs.where("false"), asked, 2).count() == 0
    assert pivots.nearest_join(docs, asked.where("false"), 2).count() == 0
    with pytest.raises(ValueError, match="positive"):
        pivots.nearest_join(docs, asked, 0)


def test_bundles_hold_every_partition_once():
    for sizes, most in (([3, 0, 4, 25, 1, 1, 9, 0], 10), ([0, 0], 5), ([30], 7), ([1] * 50, 16)):
        found = pivots.Bundles(np.array(sizes), most)
        assert len(found.spans) <= 2 * sum(sizes) // most + 2
        for cell, n in enumerate(sizes):
            mine = range(found.first[cell], found.first[cell] + found.shares[cell])
            assert found.shares[cell] * most >= n and all(found.spans[b][0] <= cell < found.spans[b][1] for b in mine)


def test_queries_are_sent_once_per_bundle(spark):
    docs = np.random.default_rng(5).normal(size=(3_000, 12))
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)  # nothing can be pruned
    placed, found = pivots.partitioned(table_of(spark, docs), 3, "vec", "pk", (), None)
    bundles = pivots.Bundles(found.n, 1_024)
    asked = asked_of(spark, docs[:200]).withColumn("cut", F.lit(0.5))
    rows = pivots._visits(asked, found, bundles, 3)
    partitions = sum(bin(int.from_bytes(r[0], "big")).count("1") for r in rows.select("_visited").collect())
    assert rows.count() <= 200 * len(bundles.spans) <= 200 * 4 and partitions > 200 * 20
    hits = pivots.nearest_join(table_of(spark, docs), asked_of(spark, docs[:200]), 3)
    assert found_pairs(hits) == best_pairs(docs, docs[:200], 3)


def test_partitions_are_pruned(spark):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(40, 8))[rng.integers(0, 40, 2_000)] * 6 + 0.05 * rng.normal(size=(2_000, 8))
    placed, found = pivots.partitioned(table_of(spark, docs), 3, "vec", "pk", (), 40)
    assert found.n.sum() == 2_000 == placed.count()
    asked = docs[:300]
    far = found.of_queries(asked)
    home = np.where(found.n > 0, far, np.inf).argmin(axis=1)
    scores = asked @ docs.T
    cut = np.sort(scores, axis=1)[:, -3]
    within = np.sqrt(np.maximum(0, (asked**2).sum(axis=1) + found.largest - 2 * cut))
    visited = found.visited(far, home, within)
    cell = {r["pk"]: r["cell"] for r in placed.select("pk", F.col("_cell").alias("cell")).collect()}
    for q in range(300):
        for i in np.flatnonzero(scores[q] >= cut[q]):
            assert visited[q, cell[int(i)]] or home[q] == cell[int(i)]
    assert visited.sum() < 0.2 * 300 * (found.n > 0).sum()


def test_stored_index(spark, tmp_path, monkeypatch):
    from lanefold.operators.cells import StoredCells

    rng = np.random.default_rng(9)
    centres = unit(rng.normal(size=(30, 8))).astype(float)
    docs = unit(centres[rng.integers(0, 30, 900)] + 0.05 * rng.normal(size=(900, 8))).astype(float)
    asked = unit(docs[::30] + 0.02 * rng.normal(size=(30, 8))).astype(float)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, vec array<double>")
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 10)
    path = str(tmp_path / "index")
    store = StoredCells.create(table_of(spark, docs[:600]), centroids, path)
    before = {f.name for f in (tmp_path / "index" / "vectors").glob("*/*/*.parquet")}
    queries = asked_of(spark, asked)
    assert found_pairs(store.search(queries, 5, 30)) == best_pairs(docs[:600], asked, 5)
    store.append(table_of(spark, docs[600:], list(range(600, 900))))
    assert before <= {f.name for f in (tmp_path / "index" / "vectors").glob("*/*/*.parquet")}
    assert found_pairs(store.search(queries, 5, 30)) == best_pairs(docs, asked, 5)
    # A batch whose write did not end is not in the manifest, and not read.
    table_of(spark, docs[:50], list(range(5_000, 5_050))).withColumn("cell", F.lit(1)).write.partitionBy("cell").parquet(f"{path}/vectors/batch=broken")
    few = store.search(queries, 5, 4)
    assert "dynamicpruning" in few._jdf.queryExecution().toString()
    got = found_pairs(few)
    assert len({x[:2] for x in got} & {x[:2] for x in best_pairs(docs, asked, 5)}) >= 0.95 * 150
    # Few or many queries and cells, the hits are the same.
    monkeypatch.setattr(cells, "MAX_QUERIES", 7)
    monkeypatch.setattr(cells, "MAX_CELLS", 3)
    many = store.search(queries, 5, 4)
    assert "dynamicpruning" in many._jdf.queryExecution().toString()
    assert found_pairs(many) == got
    store.append(table_of(spark, docs[:3], [10_000, 10_001, 10_002]))
    assert store.sizes.agg(F.sum("n")).first()[0] == 903


# Projection head


def test_projection_head(spark):
    import math

    from lanefold.operators import heads

    rng = np.random.default_rng(2)
    w0, b0, w1, b1 = rng.normal(size=(5, 3)), rng.normal(size=5), rng.normal(size=(2, 5)), rng.normal(size=2)
    rows = [(0, i, w.tolist(), float(b)) for i, (w, b) in enumerate(zip(w0, b0))] + [(1, i, w.tolist(), float(b)) for i, (w, b) in enumerate(zip(w1, b1))]
    kind = "layer int, unit int, weights array<double>, bias double"
    head = heads.ProjectionHead(spark.createDataFrame(rows[::-1], kind))
    assert head.dim == 2
    docs = [rng.normal(size=(n, 3)).tolist() for n in (2, 0, 4)] + [None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t array<array<float>>").repartition(2)
    got = {r["i"]: r["v"] for r in df.select("i", head.forward(F.col("t")).alias("v")).collect()}
    assert got[3] is None and got[1] == []
    for i in (0, 2):
        for token, v in zip(docs[i], got[i]):
            h = [x * 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in w0 @ np.array(token) + b0]
            want = w1 @ np.array(h) + b1
            assert v == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-5)
    for wrong in (rows[1:], rows[:5], rows + [rows[0]], [*rows[:5], (1, 0, [1.0], 0.0)]):
        with pytest.raises(ValueError):
            heads.ProjectionHead(spark.createDataFrame(wrong, kind))
    wide = spark.createDataFrame([([[1.0, 2.0]],)], "t array<array<float>>")
    with pytest.raises(Exception, match="expected tokens of width 3"):
        wide.select(head.forward(F.col("t"))).collect()
    assert np.abs(heads.erf(np.linspace(-5, 5, 1001)) - [math.erf(x) for x in np.linspace(-5, 5, 1001)]).max() < 2e-7
