"""The collection, running totals, percentiles, files in and out, the service and the streams."""

import base64
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanefold import cli
from lanefold.embedding.pseudo import PseudoEmbedder, mean_pool
from lanefold.operators import frames as K, ledger as L, percentiles as P, robustness as B, sizing, stub
from lanefold.operators import evaluation as E, profiling as R
from lanefold.schemas import TASKS
from lanefold.service import QueryRequest, QueryService, QueryValidationError, request_loop
from lanefold.sinks import reports, tables
from lanefold.sources import ledger as ledger_source, tasks as task_source, texts, vectors
from lanefold.streaming import upsert


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows share one key."""
    rows = [("hot" if i % 3 else f"k{i % 5}", i, float((i * 37) % 101)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, i long, v double").repartition(6)


def test_running_total(skewed):
    got = sizing.running_total(skewed, ["k"], ["i"], "n").collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["i"]):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["n"] == seen[r["k"]]
    whole = sizing.running_total(skewed, [], ["i"], "s", F.col("v")).collect()
    total = 0.0
    for r in sorted(whole, key=lambda r: r["i"]):
        total += r["v"]
        assert r["s"] == pytest.approx(total)
    places = sizing.dense_ordinal(skewed, ["k"], ["i"], "n")
    assert places.agg(F.min("n")).first()[0] == 0


def test_percentiles(spark, skewed):
    rows = {r["k"]: r for r in P.latency_stats(skewed, ["k"], "v").collect()}
    upper = {r["k"]: r for r in P.upper_median_and_p95(skewed, ["k"], "v").collect()}
    true = {r["k"]: r for r in P.true_median_and_p95(skewed, ["k"], "v").collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for k, vs in values.items():
        vs = sorted(vs)
        n = len(vs)
        assert rows[k]["n"] == n and rows[k]["mean_ms"] == pytest.approx(np.mean(vs))
        for name, p in (("p50_ms", 50), ("p95_ms", 95), ("p99_ms", 99)):
            assert rows[k][name] == pytest.approx(np.percentile(vs, p))
        assert upper[k]["p50_ms"] == vs[n // 2] and upper[k]["p95_ms"] == vs[min(n - 1, round(0.95 * (n - 1)))]
        assert true[k]["p50_ms"] == np.median(vs) and true[k]["p95_ms"] == vs[max(0, round(0.95 * n) - 1)]
    few = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert P.latency_stats(few, [], "v").first()["p95_ms"] == pytest.approx(8.95)


LANES = "lane string, video_id string, row long, frame_id string, vec array<float>"


def lane_rows(lane, video, ids, width=2):
    return [(lane, video, i, f, [float(i)] * width) for i, f in enumerate(ids)]


def test_align_lanes(spark):
    rows = lane_rows("a", "v1", ["0", "1", "2"]) + lane_rows("b", "v1", ["2", "0", "1"], 3)
    rows += lane_rows("a", "v2", ["0", "1"]) + lane_rows("b", "v2", ["0", "1"], 3)
    got = {r["pk"]: r for r in K.align_lanes(spark.createDataFrame(rows, LANES), {"a": 2, "b": 3}).collect()}
    assert len(got) == 5 and got["v1_2"]["frame_idx"] == 2 and got["v1_2"]["b"] == [0.0] * 3
    assert got["v2_0"]["frame_id"] == got["v1_0"]["frame_id"]


def test_repeated_frame_ids_keep_the_last(spark):
    rows = lane_rows("a", "v", ["x", "y", "x"])
    got = {r["pk"]: r for r in K.align_lanes(spark.createDataFrame(rows, LANES), {"a": 2}).collect()}
    assert got["v_x"]["frame_idx"] == 2 and got["v_x"]["a"] == [2.0, 2.0]


@pytest.mark.parametrize(
    "rows, dims, message",
    [
        (lane_rows("a", "v", ["0", "1"]) + lane_rows("b", "v", ["0"]), {"a": 2, "b": 2}, "lane 'b' lacks frame v_1"),
        (lane_rows("a", "v", ["0"]), {"a": 8}, "field 'a': expected dim 8, actual 2"),
    ],
)
def test_align_errors(spark, rows, dims, message):
    with pytest.raises(Exception, match=message):
        K.align_lanes(spark.createDataFrame(rows, LANES), dims).collect()


def test_upsert_and_enrich(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "pk string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "pk string, v int, seq int")
    assert {r["pk"]: r["v"] for r in K.upsert(old, new, ["pk"], "seq").collect()} == {"a": 1, "b": 3, "c": 9}
    meta = spark.createDataFrame([("b", None, "text", ["t"])], "pk string, youtube_url string, description string, od_tags array<string>")
    rows = {r["pk"]: r for r in K.enrich(old.select("pk"), meta).collect()}
    assert rows["a"]["description"] == "" and rows["a"]["od_tags"] == [] and rows["b"]["od_tags"] == ["t"] and rows["b"]["youtube_url"] == ""
    long = spark.createDataFrame([("x" * 400,)], "pk string")
    with pytest.raises(Exception, match="pk exceeds 384"):
        K.checked_strings(long).collect()


def test_neighbours_stop_at_gaps(spark):
    df = spark.createDataFrame([("a", "v", 0), ("b", "v", 1), ("c", "v", 3), ("d", "w", 1)], "pk string, video_id string, frame_idx long")
    assert {r["pk"]: r["neighbours"] for r in K.neighbours(df).collect()} == {"a": ["b"], "b": ["a"], "c": [], "d": []}
    long = spark.range(50).where("id % 7 <> 3").selectExpr("cast(id as string) pk", "'v' video_id", "id frame_idx").repartition(4)
    have = {r["frame_idx"] for r in long.collect()}
    for stretch in (1, 2, 5, 1000):
        got = {r["pk"]: r["neighbours"] for r in K.neighbours(long, stretch).collect()}
        assert got == {str(i): [str(j) for j in (i - 1, i + 1) if j in have] for i in have}


def test_features_strict_and_not(spark):
    have = spark.createDataFrame([("v_001", [0.0, 1.0])], "key string, vec array<float>")
    asked = spark.createDataFrame([("v_001",), ("v_002",)], "key string")
    rows = {r["key"]: r for r in K.lookup_features(asked, have, 2, strict=False).collect()}
    assert rows["v_002"]["vec"] == [0.0, 0.0] and not rows["v_002"]["found"]
    with pytest.raises(Exception, match="no feature for key v_002"):
        K.lookup_features(asked, have, 2).collect()


# files


@pytest.fixture
def index_root(tmp_path):
    rng = np.random.default_rng(0)
    for lane, dim in (("siglip2", 8), ("metaclip2", 6)):
        os.makedirs(tmp_path / lane)
        for video, n in (("L25_V011", 4), ("L25_V012", 3)):
            m = rng.standard_normal((n, dim)).astype(np.float32)
            np.save(tmp_path / lane / f"{video}.npy", m / np.linalg.norm(m, axis=1, keepdims=True))
            with open(tmp_path / lane / f"{video}.manifest.jsonl", "w") as out:
                for i in range(n):
                    out.write(json.dumps({"row": 99, "frame_id": f"{i:04d}", "path": f"{video}/{i:04d}.jpg"}) + "\n\n")
    return str(tmp_path)


def test_index_files_to_service(spark, index_root, tmp_path):
    dims = {"siglip2": 8, "metaclip2": 6}
    meta_path = str(tmp_path / "meta.jsonl")
    with open(meta_path, "w") as out:
        out.write(json.dumps({"pk": "L25_V011_0001", "description": "old"}) + "\n")
        out.write(json.dumps({"video_id": "L25_V011", "frame_id": "0001", "description": "new", "od_tags": ["car"]}) + "\n")
        out.write(json.dumps({"frame_id": "0002", "description": "never matches"}) + "\n")
    store = str(tmp_path / "store")
    args = ["--index-root", index_root, "--fields", "metaclip2,siglip2", "--metadata", meta_path]
    with pytest.raises(Exception, match="dim mismatch for field"):
        cli.cmd_ingest(spark, cli.parser().parse_args(["ingest", "--uri", store, *args]))
    lanes = vectors.read_index(spark, index_root, dims)
    frames = K.enrich(K.align_lanes(lanes, dims), vectors.read_metadata(spark, meta_path))
    tables.write_index(frames, store)
    index = spark.read.parquet(store)
    rows = {r["pk"]: r for r in index.collect()}
    assert len(rows) == 7 and rows["L25_V011_0001"]["description"] == "new" and rows["L25_V011_0002"]["description"] == ""
    assert rows["L25_V011_0003"]["frame_idx"] == 3
    assert rows["L25_V011_0003"]["siglip2"] == pytest.approx(np.load(f"{index_root}/siglip2/L25_V011.npy")[3].tolist())

    service = QueryService(index, {"siglip2": PseudoEmbedder(8), "metaclip2": PseudoEmbedder(6)}, index_root)
    answer = service.respond(QueryRequest("một con mèo", ("siglip2", "metaclip2", "siglip2"), 5, "rrf"))
    assert [r["rank"] for r in answer["results"]] == [1, 2, 3, 4, 5] and answer["lanes"] == ["siglip2", "metaclip2"]
    assert answer["results"][0]["full_url"].startswith("/frames/L25_V01")
    detail = service.frame_detail("L25_V011_0001")
    assert detail["neighbours"] == ["L25_V011_0000", "L25_V011_0002"] and detail["od_tags"] == ["car"] and detail["youtube_url"] is None
    assert service.frame_detail("nope") is None
    ready = service.readiness()
    assert ready["ready"] and ready["row_count"] == 7 and ready["lanes_available"] == ["siglip2", "metaclip2"]
    for bad in (
        QueryRequest("  "), QueryRequest("x", ()), QueryRequest("x", ("siglip2",), fusion="rrf"), QueryRequest("x", ("siglip2", "metaclip2")),
        QueryRequest("x", ("qwen3vl",)), QueryRequest("x", top_k=0), QueryRequest("x" * 513), QueryRequest("x", fusion="other"),
    ):
        with pytest.raises(QueryValidationError):
            service.query(bad)
    loop = list(request_loop(service, ['{"query": "mèo", "top_k": 2}', "{bad", '{"query": " "}', '{"what": 1}']))
    assert len(loop[0]["results"]) == 2 and all("error" in x for x in loop[1:])
    tasks = spark.createDataFrame([("t1", "mèo"), ("t2", "chó")], "task_id string, query_vi string")
    assert service.backend("siglip2", tasks, 3).groupBy("task_id").count().where("count = 3").count() == 2


def test_missing_lane_file_and_length_mismatch(spark, index_root):
    dims = {"siglip2": 8, "metaclip2": 6}
    manifest = f"{index_root}/metaclip2/L25_V012.manifest.jsonl"
    with open(manifest, "a") as out:
        out.write(json.dumps({"frame_id": "extra"}) + "\n")
    with pytest.raises(Exception, match="length mismatch for field 'metaclip2' in L25_V012"):
        vectors.read_index(spark, index_root, dims).collect()
    with pytest.raises(Exception, match="expected dim 9"):
        vectors.read_lane(spark, index_root, "siglip2", 9).collect()
    os.rename(manifest, manifest + ".gone")
    with pytest.raises(FileNotFoundError, match="missing manifest for field 'metaclip2': video L25_V012"):
        vectors.read_index(spark, index_root, dims)
    with pytest.raises(ValueError, match="unknown field"):
        cli.lanes_of("siglip2,other")


def test_matrices_are_read_by_ranges_of_rows(spark, tmp_path):
    r = np.random.default_rng(4)
    given = {
        "long": r.standard_normal((5_000, 7)),
        "by column": np.asfortranarray(r.standard_normal((301, 5)).astype(np.float32)),
        "big end": r.integers(0, 100, (40, 3)).astype(">i4"),
        "half": r.standard_normal((3, 2)).astype(np.float16),
        "vector": np.arange(9.0),
        "none": np.zeros((0, 4)),
        "é": np.ones((1, 1)),
    }
    for name, m in given.items():
        np.save(tmp_path / f"{name}.npy", m)
    found = vectors.read_matrices(spark, str(tmp_path), range_bytes=4_000)
    tasks = found.withColumn("task", F.spark_partition_id()).where("video_id = 'long'").select("task").distinct().count()
    assert tasks > 20  # one file, many tasks
    rows = found.orderBy("video_id", "row").collect()
    assert rows == vectors.read_matrices(spark, str(tmp_path), ranged=()).orderBy("video_id", "row").collect()
    for name, m in given.items():
        mine = [x for x in rows if x.video_id == name]
        want = np.atleast_2d(m).astype(np.float32)
        assert [x.row for x in mine] == list(range(len(want))) and all(x.ndim == m.ndim for x in mine)
        assert not len(want) or (np.array([x.vec for x in mine], np.float32) == want).all()
    (tmp_path / "short.npy").write_bytes((tmp_path / "long.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="file ends before its last row"):
        vectors.read_matrices(spark, str(tmp_path)).collect()


def test_matrices_must_hold_numbers(tmp_path):
    for name, m in (("objects", np.array([[1, "a"]], dtype=object)), ("cube", np.zeros((2, 2, 2)))):
        np.save(tmp_path / f"{name}.npy", m, allow_pickle=True)
        with vectors.opened(str(tmp_path / f"{name}.npy")) as file, pytest.raises(ValueError, match="not a matrix of numbers"):
            vectors.read_header(file)


def test_feature_store_layouts(spark, tmp_path):
    m = np.array([[3.0, 4.0], [0.0, 2.0], [1.0, 0.0]], dtype=np.float32)
    one, per_video, per_id = (str(tmp_path / n) for n in ("one", "video", "id"))
    for d in (one, per_video, per_id):
        os.makedirs(d)
    np.save(f"{one}/all.npy", m)
    with open(f"{one}/ids.txt", "w") as out:
        out.write("x\ny\nz\n")
    rows = {r["key"]: r["vec"] for r in vectors.read_features(spark, one).collect()}
    assert set(rows) == {"x", "y", "z"} and rows["x"] == pytest.approx([0.6, 0.8])
    np.save(f"{per_video}/L25_V011.npy", m)
    np.save(f"{per_video}/L26_V001.npy", m[:2])
    keys = {r["key"] for r in vectors.read_features(spark, per_video).collect()}
    assert keys == {"L25_V011_001", "L25_V011_002", "L25_V011_003", "L26_V001_001", "L26_V001_002"}
    np.save(f"{per_id}/f1.npy", m[0])
    np.save(f"{per_id}/f2.npy", m[1])
    rows = {r["key"]: r["vec"] for r in vectors.read_features(spark, per_id).collect()}
    assert rows["f2"] == pytest.approx([0.0, 1.0]) and set(rows) == {"f1", "f2"}


def task(kind="KIS", **over):
    truth = {"KIS": {"kis_frame_ids": ["a"]}, "QA": {"qa_answer": "x"}, "AD_HOC": {"adhoc_frame_ids": ["a", "b"]}, "TRAKE": {"trake_frame_ids": list("abcd")}}
    base = {"task_id": f"{kind}-1", "task_type": kind, "query_vi": "hỏi", "time_limit_seconds": 300, "ground_truth": truth.get(kind, {}), "metadata": {"n": 1}}
    return json.dumps({**base, **over}, ensure_ascii=False)


def test_task_files_and_eval_command(spark, tmp_path):
    folder = tmp_path / "tasks"
    os.makedirs(folder)
    lines = [task(k, task_id=f"{k}-{i}") for k in ("TRAKE", "KIS", "QA", "AD_HOC") for i in range(5)]
    (folder / "b.jsonl").write_text("\n\n".join(lines[:10]), encoding="utf-8")
    (folder / "a.jsonl").write_text("\n".join(lines[10:]) + "\n  \n", encoding="utf-8")
    (folder / "notes.txt").write_text("no task")
    tasks = task_source.read_tasks(spark, str(folder))
    ids = [r["task_id"] for r in tasks.collect()]
    assert len(ids) == 20 and ids == sorted(ids)
    out = str(tmp_path / "out")
    cli.cmd_eval(spark, cli.parser().parse_args(["eval", "--tasks", str(folder), "--system", "s", "--output", out]))
    document = json.loads(open(f"{out}/metrics.json", encoding="utf-8").read())
    assert document["schema_version"] == "2" and document["n_tasks"] == 20 and set(document["by_task_type"]) == {"KIS", "QA", "AD_HOC", "TRAKE"}
    assert 0 < document["overall"]["mean_mrr"] <= 1 and 10 <= document["latency"]["p50_ms"] <= 30
    assert "<table>" in open(f"{out}/report.html").read() and "mean_r_at_1" in open(f"{out}/README.md").read()
    assert spark.read.json(f"{out}/tasks").count() == 20
    with pytest.raises(ValueError, match="reserved"):
        cli.cmd_eval(spark, cli.parser().parse_args(["eval", "--tasks", "x", "--system", "s", "--baseline", "b"]))


@pytest.mark.parametrize(
    "line, message",
    [
        ("{broken", "invalid JSON"),
        (task(task_type=None), "task_type: field required"),
        (task(task_type="OTHER"), "task_type: must be"),
        (task(surprise=1), "surprise: unknown field"),
        (task(ground_truth={"kis_frame_ids": ["a"], "odd": 1}), "ground_truth.odd: unknown field"),
        (task("QA", ground_truth={"kis_frame_ids": ["a"]}), "ground_truth.qa_answer: missing or empty"),
        (task("TRAKE", ground_truth={"trake_frame_ids": ["a"]}), "lists four"),
        (task(time_limit_seconds=0), "greater than 0"),
    ],
)
def test_bad_task_lines_are_located(spark, tmp_path, line, message):
    path = tmp_path / "t.jsonl"
    path.write_text(task() + "\n\n" + line + "\n" + task() + "\n", encoding="utf-8")
    with pytest.raises(task_source.TaskLoadError, match=message) as err:
        task_source.read_tasks(spark, str(path))
    assert "t.jsonl:3:" in str(err.value)


def test_empty_task_folder(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(task_source.TaskLoadError, match="no tasks"):
        task_source.read_tasks(spark, str(tmp_path))


def test_strings_from_files(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    (tmp_path / "q-kis-1.TXT").write_text("  line one \n\nline two\n", encoding="utf-8")
    (tmp_path / "sub" / "p.json").write_text('{"a": ["text one", "abc"], \n "b": {"c": "text two"}}')
    (tmp_path / "sub" / "p.jsonl").write_text('{"a": "text three"}\nnot json\n{"a": 5}\n')
    (tmp_path / "skip.bin").write_text("never read")
    (tmp_path / "broken.xlsx").write_bytes(b"no sheet")
    got = sorted(r["text"] for r in texts.read_strings(spark, str(tmp_path)).collect())
    assert got == ["line one", "line two", "text one", "text three", "text two"]
    assert texts.read_strings(spark, str(tmp_path / "skip.bin")).first()["text"] == "never read"
    (tmp_path / "a-kis-2.txt").write_text("whole \n file", encoding="utf-8")
    (tmp_path / "other.txt").write_text("other", encoding="utf-8")
    whole = [r["text"] for r in texts.read_queries(spark, str(tmp_path), collapse=True).collect()]
    assert whole == ["whole file"]
    lines = texts.read_queries(spark, str(tmp_path / "q-kis-1.TXT"), max_queries=1).collect()
    assert [r["text"] for r in lines] == ["line one"]
    with pytest.raises(ValueError):
        texts.held_out_or_file(spark, None, None)


def test_images_and_vector_writer(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    for name in ("b.JPG", "a.png", "c.txt", "deep/d.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r["path"].rsplit("/", 1)[-1] for r in texts.discover_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    assert texts.sample_keyframes(spark, str(tmp_path), 9).count() == 1
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.{JPG,png}").load(str(tmp_path)).select("path", "content")
    embedder = PseudoEmbedder(16)
    out = str(tmp_path / "vec")
    assert tables.write_vectors(content, embedder, out) == 2
    rows = spark.read.parquet(out).orderBy("row").collect()
    assert [(r["row"], r["frame_id"]) for r in rows] == [(0, "a"), (1, "b")]
    import hashlib

    digest = hashlib.sha256(b"a.png").hexdigest()
    assert rows[0]["vec"] == pytest.approx(embedder.vectors([f"image:{digest}"])[0].tolist())
    with pytest.raises(Exception, match="deviates from 1"):
        spark.range(1).select(tables.checked_unit(F.array(F.lit(2.0)))).collect()


def test_pseudo_embedder(spark):
    e = PseudoEmbedder(32)
    df = spark.createDataFrame([("xin chào",), ("",), ("xin chào",)], "t string")
    rows = [r["v"] for r in df.select(e.encode_text(F.col("t")).alias("v")).collect()]
    assert rows[0] == rows[2] and np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-6)
    import hashlib

    seed = int.from_bytes(hashlib.sha256("dummy-32|xin chào".encode()).digest()[:8], "big")
    raw = np.random.default_rng(seed).standard_normal(32, dtype=np.float32)
    assert rows[0] == pytest.approx((raw / np.linalg.norm(raw)).tolist(), abs=1e-6)
    pooled = df.select(mean_pool(e.encode_tokens(F.col("t")), 32).alias("v")).collect()
    both = e.vectors(["xin", "chào"]).mean(axis=0)
    assert pooled[0]["v"] == pytest.approx((both / np.linalg.norm(both)).tolist(), abs=1e-5)
    assert pooled[1]["v"] == [0.0] * 32
    with pytest.raises(ValueError):
        PseudoEmbedder(0)


# ledger and preconditions


def test_ledger(spark, tmp_path):
    import datetime as dt

    where = str(tmp_path / "ledger")
    for i, code in enumerate((0, 1, None)):
        start = dt.datetime(2026, 1, 1 + i, 12, 0, 0)
        tables.append_run(spark, tables.Run(f"abcdef{i}-job-x", "abcdef0", "a" if i else "b", start, None, code, "p", ("k",), {"E": "1"}), where)
    where = where + "/*"
    rows = ledger_source.read_ledger(spark, where, 2).collect()
    assert [r["exit_code"] for r in rows] == [1, None] and rows[0]["env"] == {"E": "1"}
    assert ledger_source.read_ledger(spark, where, 0).count() == 3
    assert [r["run_id"] for r in ledger_source.read_ledger(spark, where, 1, job="b").collect()] == ["abcdef0-job-x"]


def test_preflight(spark, tmp_path):
    os.makedirs(tmp_path / "models")
    (tmp_path / "models" / "best.pt").write_text("x")
    keys = ledger_source.object_keys(spark, str(tmp_path))
    assert [r["key"] for r in keys.collect()] == ["models/best.pt"]
    rows = L.prefix_counts(keys, ["models/", "data/", "models/"]).orderBy("ord").collect()
    assert [(r["prefix"], r["n_found"]) for r in rows] == [("models/", 1), ("data/", 0)]
    with pytest.raises(L.PreflightError, match="data/"):
        L.require_prefixes(keys, ["models/", "data/"])
    L.require_prefixes(keys, [])
    assert L.first_with_suffix(keys, "models", ".pt").first()["key"] == "models/best.pt"


# robustness


@pytest.mark.parametrize(
    "mine, base, expected",
    [(1, 11, "clean_win"), (10, 11, "clean_win"), (1, 10, "tie"), (3, 3, "tie"), (5, 4, "loss"), (11, 12, "graceful"), (50, 1370, "graceful"), (None, 1, "n/a"), (1, None, "n/a")],
)
def test_verdict(spark, mine, base, expected):
    df = spark.createDataFrame([(mine, base)], "m long, b long")
    assert df.select(B.verdict(F.col("m"), F.col("b")).alias("v")).first()["v"] == expected


def test_best_seed(spark):
    rows = [("a", 1, 2, 30), ("a", 2, 1, 30), ("a", 3, 5, 90), ("b", 1, 20, 40), ("b", 2, 15, 99), ("b", 3, 12, 3), ("c", 7, 4, 2), ("c", 8, 3, 2)]
    df = spark.createDataFrame(rows, "g string, seed long, candidate_rank long, best_baseline long")
    assert {r["g"]: r["seed"] for r in B.best_seed(df, ["g"]).collect()} == {"a": 3, "b": 2, "c": 8}


def test_degradation(spark):
    texts_ = [f"từ số {i} là một câu ngắn gọn thứ {i * 7}" for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "qid long, text string")
    e = PseudoEmbedder(32)
    for retrieve in (B.late_interaction_retriever(e.encode_tokens), B.dense_retriever(e.encode_text), B.pooled_retriever(e)):
        rows = {r["mode"]: r["degradation"] for r in B.degradation_at_k(df, retrieve, k=5, modes=("drop_all", "case_noise")).collect()}
        assert set(rows) == {"drop_all", "case_noise", "overall"}
        assert rows["overall"] == pytest.approx((rows["drop_all"] + rows["case_noise"]) / 2)
    ascii_ = df.withColumn("text", F.concat(F.lit("plain "), F.col("qid")))
    rows = {r["mode"]: r["degradation"] for r in B.degradation_at_k(ascii_, B.dense_retriever(e.encode_text), k=1, modes=("drop_all",)).collect()}
    assert rows == {"drop_all": 1.0, "overall": 1.0}
    with pytest.raises(ValueError):
        B.degradation_at_k(df, retrieve, k=0)
    with pytest.raises(ValueError):
        B.degradation_at_k(df.where("false"), retrieve)


def test_gold_rank_ties_by_key(spark):
    scores = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.5, 0.9, 0.5, 0.5])], "qid long, did long, score double")
    gold = spark.createDataFrame([(1, 2)], "qid long, gold long")
    assert B.gold_ranks(scores, gold).first()["rank"] == 3


# stub and streams


def test_stub(spark):
    rows = [json.loads(task(k, task_id=f"{k}-{i}")) for k in ("KIS", "QA", "AD_HOC", "TRAKE") for i in range(60)]
    tasks = spark.createDataFrame(
        [(r["task_id"], r["task_type"], r["query_vi"], None, 300, tuple(r["ground_truth"].get(f.name) for f in TASKS["ground_truth"].dataType), {}) for r in rows], TASKS
    )
    answers = stub.answer(tasks, 1)
    assert sorted(map(tuple, answers.collect()), key=str) == sorted(map(tuple, stub.answer(tasks.repartition(5), 1).collect()), key=str)
    per = {r["task_id"]: r["n"] for r in answers.groupBy("task_id").agg(F.count("*").alias("n")).collect()}
    assert all(n == (1 if t.startswith("QA") else 10) for t, n in per.items()) and len(per) == 240
    assert answers.where("elapsed_ms < 10 or elapsed_ms > 30").count() == 0
    shown = answers.where("task_id like 'QA%' and text = 'x'").count()
    assert 30 <= shown <= 54
    kis = answers.where("frame_id = 'a' and task_id like 'KIS%'").select("task_id", "rank").collect()
    import hashlib

    assert 30 <= len(kis) <= 54
    for r in kis:
        assert r["rank"] == int.from_bytes(hashlib.sha256(r["task_id"].encode()).digest()[:4], "big") % 10 + 1
    timed = tasks.join(answers.groupBy("task_id").agg(F.max("elapsed_ms").alias("elapsed_ms")), "task_id")
    timed = timed.withColumn("qa_answer", F.col("ground_truth.qa_answer")).withColumn("qa_acceptable", F.col("ground_truth.qa_answer_acceptable"))
    overall = {r["task_type"]: r for r in E.roll_up(E.score_tasks(timed, answers, E.truth_of(tasks))).collect()}
    assert 0.5 < overall["TRAKE"]["n_correct"] / 60 < 0.9


def test_stream_takes_new_files_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    row = "pk string, v int, seq int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], row).coalesce(1).write.parquet(source)
    upsert.start(spark, source, target, progress, ["pk"], "seq").awaitTermination()
    assert {r["pk"]: r["v"] for r in upsert.current(spark, target, ["pk"]).collect()} == {"a": 2, "b": 1}
    spark.createDataFrame([("b", 7, 0), ("c", 5, 1)], row).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        upsert.start(spark, source, target, progress, ["pk"], "seq").awaitTermination()
    assert {r["pk"]: r["v"] for r in upsert.current(spark, target, ["pk"]).collect()} == {"a": 2, "b": 7, "c": 5}
    table = upsert.KeyedTable(spark, target, ["pk"])
    assert not table.merge(spark.createDataFrame([("c", 6, 1)], row), 1, "seq")  # batch 1 run again
    assert {r["pk"]: r["v"] for r in upsert.current(spark, target, ["pk"]).collect()} == {"a": 2, "b": 7, "c": 5}


def test_keyed_table_rewrites_only_what_a_batch_touches(spark, tmp_path, monkeypatch):
    path, kind = str(tmp_path / "table"), "k long, seq long, v string"
    table = upsert.KeyedTable(spark, path, ["k"], buckets=8)
    with pytest.raises(ValueError, match="nothing"):
        table.rows()
    assert table.merge(spark.createDataFrame([(i, 0, f"a{i}") for i in range(200)], kind), 0, "seq")
    before = dict(table.manifest["folders"])
    assert len(before) == 8
    assert table.merge(spark.createDataFrame([(7, 1, "x"), (7, 5, "y"), (7, 3, "z")], kind), 1, "seq")
    assert sum(before[b] != f for b, f in table.manifest["folders"].items()) == 1
    want = {i: f"a{i}" for i in range(200)} | {7: "y"}
    read = lambda: {r["k"]: r["v"] for r in upsert.KeyedTable(spark, path, ["k"]).rows().collect()}
    assert read() == want and table.rows().count() == 200

    # A batch that dies before its commit is not seen, and runs again as if it had never been.
    commit = upsert.KeyedTable._commit
    monkeypatch.setattr(upsert.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    late = spark.createDataFrame([(i, 0, f"b{i}") for i in range(150, 250)], kind)
    with pytest.raises(OSError, match="lost"):
        table.merge(late, 2, "seq")
    assert read() == want
    monkeypatch.setattr(upsert.KeyedTable, "_commit", commit)
    again = upsert.KeyedTable(spark, path, ["k"])
    assert again.merge(late, 2, "seq") and not again.merge(late, 2, "seq")
    want |= {i: f"b{i}" for i in range(150, 250)}
    assert read() == want
    # Two writers of one version: the second one is told.
    with pytest.raises(RuntimeError, match="another writer"):
        again._commit({**again.manifest})
    assert again.merge(late.where("false"), 3, "seq") and read() == want


def test_contact_sheet(spark, tmp_path):
    hits = spark.createDataFrame([(1, "a", "x", 0.5, 1)], "qid long, pk string, lane string, score double, rank long")
    asked = spark.createDataFrame([(1, "<b>hỏi</b>")], "qid long, text string")
    reports.write_contact_sheet(hits, asked, str(tmp_path / "s" / "sheet.html"))
    assert "&lt;b&gt;hỏi" in open(tmp_path / "s" / "sheet.html", encoding="utf-8").read()


def test_samples_and_shards(spark):
    df = spark.range(100).repartition(7)
    assert [r["id"] for r in R.stride_sample(df, ["id"], 4).orderBy("id").collect()] == [0, 25, 50, 75]
    assert R.shard_of(df, ["id"], 3).where("shard <> id % 3").count() == 0
    common = spark.createDataFrame([("b", 0), ("a", 1), ("a", 2), ("b", 3), ("c", 4)], "x string, i int")
    assert [r["x"] for r in R.most_common(common, "x", 2, "i").collect()] == ["b", "a"]


def test_ship_gate(spark):
    def scores(overall):
        return spark.createDataFrame([("drop_all", 0.1), ("overall", overall)], "mode string, degradation double")

    row = B.ship_gate(scores(0.9), scores(0.8), scores(0.7)).first()
    assert row["passes_ship_gate"] and row["overall"] == 0.9 and row["baseline_dense"] == 0.7
    assert not B.ship_gate(scores(0.9), scores(0.9), scores(0.7)).first()["beats_maxsim"]
    assert not B.ship_gate(scores(0.84), scores(0.1), scores(0.1)).first()["passes_absolute"]


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace

    from lanefold import session

    unset = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        context = SimpleNamespace(getConf=lambda: unset, getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.scratch_dir(SimpleNamespace(sparkContext=context, conf=unset))
