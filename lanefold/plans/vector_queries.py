"""Vectors, the keyframe collection, search and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions import vectors as V
from lanefold.functions.identifiers import full_url, thumb_url
from lanefold.operators import cells, frames as K, fusion, heads, pivots, search
from lanefold.plans.inputs import (
    LANES,
    frames,
    lane_sql,
    lane_vectors,
    prototype_sql,
    prototypes,
    table,
    topk_sql,
    unit_sql,
)
from lanefold.plans.registry import query
from lanefold.session import scratch_path

TOP = 10
RRF_K = 60
PROBES = 3


def _hits(spark: SparkSession, sf: str, lane: str, k: int = TOP) -> DataFrame:
    return search.top_k(
        frames(spark, sf, lane),
        prototypes(spark, sf, lane),
        k,
        carry=("video_id", "frame_id"),
        dim=LANES[lane],
    )


def _hits_sql(lane: str, k: int = TOP) -> str:
    return topk_sql(prototype_sql(lane), lane_sql(lane), k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "pk", "video_id", "frame_id", F.round("score", 6).alias("score"), "rank")


SHOWN = "qid, pk, video_id, frame_id, round(score, 6) AS score, rank"


@query("vector_topk_exact", f"SELECT {SHOWN} FROM ({_hits_sql('a')})")
def vector_topk_exact(spark, sf):
    return _shown(_hits(spark, sf, "a"))


@query(
    "vector_topk_filtered",
    "SELECT " + SHOWN + " FROM ("
    + topk_sql(prototype_sql("a"), lane_sql("a"), TOP, "video_id = 'L3' OR (video_id <> 'L7' AND label >= 5)")
    + ")",
)
def vector_topk_filtered(spark, sf):
    docs = frames(spark, sf, "a")
    where = search.filter_sql('video_id == "L3" or (video_id != "L7" and label >= 5)', docs.columns)
    hits = search.top_k(
        docs, prototypes(spark, sf), TOP, carry=("video_id", "frame_id"), where=where, dim=LANES["a"]
    )
    return _shown(hits)


@query(
    "vector_self_neighbours",
    "SELECT qid, pk, round(score, 6) AS score, rank FROM ("
    + topk_sql(f"SELECT vec_id AS qid, vec AS qvec FROM ({lane_sql('a')})", lane_sql("a"), 3)
    + ")",
)
def vector_self_neighbours(spark, sf):
    docs = frames(spark, sf, "a")
    asked = docs.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))
    hits = pivots.nearest_join(docs, asked, 3)
    return hits.select("qid", "pk", F.round("score", 6).alias("score"), "rank")


@query(
    "l2_normalize_norms",
    f"""SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm_before,
        round(sqrt(list_dot_product(u, u)), 5) AS norm_after, round(u[1], 5) AS first_component
      FROM (SELECT vec_id, v, {unit_sql('v')}::FLOAT[]::DOUBLE[] AS u FROM (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings))""",
)
def l2_normalize_norms(spark, sf):
    raw = table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform(V.as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1)).alias("v"),
    )
    unit = raw.withColumn("u", V.l2_normalise(F.col("v")))
    return unit.select(
        "vec_id",
        F.round(V.norm(F.col("v")), 5).alias("norm_before"),
        F.round(V.norm(F.col("u")), 5).alias("norm_after"),
        F.round(F.col("u")[0].cast("double"), 5).alias("first_component"),
    )


@query(
    "mrl_truncate_norms",
    f"""SELECT vec_id, len(vec)::BIGINT AS dim, round(sqrt(list_dot_product(vec, vec)), 5) AS norm,
        round(vec[1], 5) AS head, round(vec[32], 5) AS tail FROM ({lane_sql('b')})""",
)
def mrl_truncate_norms(spark, sf):
    v = F.col("vec")
    return frames(spark, sf, "b").select(
        "vec_id",
        F.size(v).cast("long").alias("dim"),
        F.round(V.norm(v), 5).alias("norm"),
        F.round(v[0].cast("double"), 5).alias("head"),
        F.round(v[31].cast("double"), 5).alias("tail"),
    )


@query(
    "norm_tolerance",
    f"""SELECT video_id, count(*) AS n, round(max(abs(sqrt(list_dot_product(vec, vec)) - 1)), 5) AS max_deviation,
        bool_and(abs(sqrt(list_dot_product(vec, vec)) - 1) <= 1e-3) AS ok
      FROM ({lane_sql('a')}) GROUP BY video_id""",
)
def norm_tolerance(spark, sf):
    deviation = V.norm_deviation(F.col("vec"))
    return frames(spark, sf, "a").groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max(deviation), 5).alias("max_deviation"),
        F.bool_and(deviation <= V.NORM_TOLERANCE).alias("ok"),
    )


def _collection(spark: SparkSession, sf: str) -> DataFrame:
    numbered = K.number_rows(lane_vectors(spark, sf), ["vec_id"])
    return K.align_lanes(numbered, LANES)


_IDX = f"SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS frame_idx FROM ({lane_sql('a')})"


@query(
    "keyframe_build",
    f"""SELECT a.pk, a.video_id, a.frame_id, a.frame_idx, coalesce('https://video.example/' || l.doc_id, '') AS youtube_url,
        coalesce('quality ' || l.quality, '') AS description, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS od_tags,
        round(a.vec[1], 5) AS a0, round(b.vec[1], 5) AS b0, round(c.vec[1], 5) AS c0
      FROM ({_IDX}) a JOIN ({lane_sql('b')}) b USING (pk) JOIN ({lane_sql('c')}) c USING (pk)
      LEFT JOIN labels l ON l.doc_id = a.vec_id""",
)
def keyframe_build(spark, sf):
    meta = (
        table(spark, sf, "labels")
        .join(frames(spark, sf).select(F.col("vec_id").alias("doc_id"), "pk"), "doc_id")
        .select(
            "pk",
            F.concat(F.lit("https://video.example/"), "doc_id").alias("youtube_url"),
            F.concat(F.lit("quality "), "quality").alias("description"),
            F.when(F.col("toxic") == 1, F.array(F.lit("toxic")))
            .otherwise(F.array().cast("array<string>"))
            .alias("od_tags"),
        )
    )
    built = K.checked_strings(K.enrich(_collection(spark, sf), meta))
    return built.select(
        "pk",
        "video_id",
        "frame_id",
        "frame_idx",
        "youtube_url",
        "description",
        F.array_join("od_tags", ",").alias("od_tags"),
        *[F.round(F.col(n)[0].cast("double"), 5).alias(f"{n}0") for n in LANES],
    )


@query(
    "lane_align_guard",
    f"""SELECT video_id, count(*) AS n_frames, count(*) AS n_a, count(*) AS n_b,
        count(*) FILTER (vec[1] >= 0) AS n_c,
        CASE WHEN count(*) FILTER (vec[1] >= 0) < count(*) THEN 'c' ELSE '' END AS incomplete_lanes,
        count(*) FILTER (vec[1] >= 0) = count(*) AS aligned
      FROM ({lane_sql('c')}) GROUP BY video_id""",
)
def lane_align_guard(spark, sf):
    """Lane c lacks the frames whose first component is negative."""
    partial = lane_vectors(spark, sf).where((F.col("lane") != "c") | (F.col("vec")[0] >= 0))
    return K.lane_coverage(partial.withColumn("row", F.col("vec_id")), list(LANES))


@query(
    "lane_align_repeated_ids",
    f"""SELECT video_id, count(DISTINCT frame_id) AS n, max(frame_idx) AS last_idx, round(sum(first), 5) AS sum_first
      FROM (SELECT video_id, frame_id, frame_idx, vec[1] AS first, row_number() OVER (
              PARTITION BY video_id, frame_id ORDER BY frame_idx DESC) AS back
            FROM (SELECT label::VARCHAR AS video_id, 'f' || ((vec_id * 7) // 10)::VARCHAR AS frame_id, vec,
                    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx FROM ({lane_sql('a')})))
      WHERE back = 1 GROUP BY video_id""",
)
def lane_align_repeated_ids(spark, sf):
    """Frame ids that repeat within a video: the last row of an id counts."""
    base = frames(spark, sf).select(
        F.lit("a").alias("lane"),
        F.col("label").cast("string").alias("video_id"),
        F.concat(F.lit("f"), F.expr("(vec_id * 7) div 10")).alias("frame_id"),
        "vec_id",
        "vec",
    )
    built = K.align_lanes(K.number_rows(base, ["vec_id"]), {"a": LANES["a"]})
    return built.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("frame_idx").alias("last_idx"),
        F.round(F.sum(F.col("a")[0].cast("double")), 5).alias("sum_first"),
    )


@query(
    "metadata_left_join",
    """SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce('toxic ' || toxic, '') AS description,
        quality IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)""",
)
def metadata_left_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"),
        F.coalesce(F.concat(F.lit("toxic "), "toxic"), F.lit("")).alias("description"),
        F.col("quality").isNotNull().alias("found"),
    )


@query(
    "metadata_last_line_wins",
    """SELECT key, line, role, md5(text) AS text_md5 FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY line DESC) AS back FROM (
          SELECT CASE WHEN role = 'system' THEN 'sys' || conv_id
                      WHEN turn = 0 THEN conv_id || '_' || role ELSE role || (turn // 2) END AS key,
                 conv_id * 1000 + turn AS line, role, text FROM conversations)) WHERE back = 1""",
)
def metadata_last_line_wins(spark, sf):
    """Rows keyed by pk, else video and frame, else the bare frame id; the last line of a key wins."""
    lines = table(spark, sf, "conversations").select(
        F.when(F.col("role") == "system", F.concat(F.lit("sys"), "conv_id")).alias("pk"),
        F.when(F.col("turn") == 0, F.col("conv_id").cast("string")).alias("video_id"),
        F.when(F.col("turn") == 0, F.col("role"))
        .otherwise(F.concat("role", F.expr("turn div 2")))
        .alias("frame_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line"),
        "role",
        "text",
    )
    keyed = lines.select(
        K.metadata_key(F.col("pk"), F.col("video_id"), F.col("frame_id")).alias("key"), "line", "role", "text"
    )
    last = K.latest(keyed.withColumn("at", F.col("line")), ["key"], "at")
    return last.select("key", "line", "role", F.md5("text").alias("text_md5"))


@query(
    "upsert_last_wins",
    """SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, event_id DESC) AS back
        FROM (SELECT * FROM events WHERE event_type IN ('error', 'view'))) WHERE back = 1""",
)
def upsert_last_wins(spark, sf):
    """View events are there already; error events of the same users replace them."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    stored = K.latest(
        events.where(F.col("event_type") == "view").withColumn("seq", F.col("event_id")), ["user_id"], "seq"
    )
    incoming = events.where(F.col("event_type") == "error").withColumn("seq", F.col("event_id"))
    merged = K.upsert(stored, incoming, ["user_id"], "seq")
    return merged.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query(
    "frame_detail_lookup",
    f"""SELECT pk, video_id, frame_id, frame_idx, '/frames/' || video_id || '/' || frame_id || '.jpg' AS full_url,
        NULL::VARCHAR AS youtube_url, '/thumbs/' || video_id || '/' || frame_id || '.jpg' AS thumb_url
      FROM ({_IDX}) WHERE vec_id IN (SELECT user_id FROM events)""",
)
def frame_detail_lookup(spark, sf):
    """Frames that any event asks for by number; numbers without a frame give no row."""
    base = K.number_rows(
        frames(spark, sf).withColumn("lane", F.lit("a")), ["vec_id"]
    ).select(
        "vec_id", "pk", "video_id", "frame_id", F.col("row").alias("frame_idx"),
        F.lit("").alias("youtube_url"), F.lit("").alias("description"),
        F.lit(None).cast("array<string>").alias("od_tags"),
    )
    asked = table(spark, sf, "events").select(F.col("user_id").alias("vec_id")).distinct()
    keys = asked.join(frames(spark, sf).select("vec_id", "pk"), "vec_id")
    return K.frame_detail(base, keys).select(
        "pk", "video_id", "frame_id", "frame_idx", "full_url", "youtube_url",
        thumb_url(F.col("video_id"), F.col("frame_id")).alias("thumb_url"),
    )


@query(
    "frame_neighbours",
    f"""WITH f AS (SELECT pk, video_id, vec_id AS frame_idx FROM ({lane_sql('a')}))
      SELECT f.pk, coalesce(string_agg(n.pk, ',' ORDER BY n.frame_idx), '') AS neighbours
      FROM f LEFT JOIN f n ON n.video_id = f.video_id AND n.frame_idx IN (f.frame_idx - 1, f.frame_idx + 1)
      GROUP BY f.pk""",
)
def frame_neighbours(spark, sf):
    """Frame numbers with gaps: only the very next and previous numbers are neighbours."""
    base = frames(spark, sf).select("pk", "video_id", F.col("vec_id").alias("frame_idx"))
    return K.neighbours(base).select("pk", F.array_join("neighbours", ",").alias("neighbours"))


@query(
    "feature_lookup",
    f"""SELECT d.doc_id, l.vec IS NOT NULL AS found, round(coalesce(l.vec[1], 0.0), 5) AS first
      FROM documents d LEFT JOIN ({lane_sql('a')}) l ON l.vec_id = d.doc_id""",
)
def feature_lookup(spark, sf):
    """Features by key, a zero vector where there is none."""
    features = frames(spark, sf).select(F.col("vec_id").alias("key"), "vec")
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    found = K.lookup_features(asked, features, LANES["a"], strict=False)
    return found.select(
        F.col("key").alias("doc_id"), "found", F.round(F.col("vec")[0].cast("double"), 5).alias("first")
    )


def _fused(spark: SparkSession, sf: str, lanes=("a", "b")) -> DataFrame:
    hits = fusion.union_lanes({lane: _hits(spark, sf, lane) for lane in lanes})
    return fusion.reciprocal_rank_fusion(hits, TOP, RRF_K)


def _fused_sql(lanes=("a", "b")) -> str:
    union = " UNION ALL ".join(
        f"SELECT qid, pk, '{lane}' AS lane, score, rank FROM ({_hits_sql(lane)})" for lane in lanes
    )
    per_lane = ", ".join(f"max(score) FILTER (lane = '{lane}') AS score_{lane}" for lane in lanes)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pk) AS rank FROM (
        SELECT qid, pk, list_sum(list(1.0::DOUBLE / ({RRF_K}.0::DOUBLE + rank) ORDER BY lane)) AS score, {per_lane}
        FROM ({union}) GROUP BY qid, pk)) WHERE rank <= {TOP}"""


@query("rrf_two_lane", f"SELECT qid, pk, round(score, 9) AS score, rank FROM ({_fused_sql()})")
def rrf_two_lane(spark, sf):
    return _fused(spark, sf).select("qid", "pk", F.round("score", 9).alias("score"), "rank")


@query("rrf_three_lane", f"SELECT qid, pk, round(score, 9) AS score, rank FROM ({_fused_sql(('a', 'b', 'c'))})")
def rrf_three_lane(spark, sf):
    return _fused(spark, sf, ("a", "b", "c")).select("qid", "pk", F.round("score", 9).alias("score"), "rank")


@query(
    "rrf_per_lane_scores",
    f"""SELECT qid, pk, rank, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b,
        'L' || split_part(pk, '_', 1)[2:] AS video_id FROM ({_fused_sql()})""",
)
def rrf_per_lane_scores(spark, sf):
    fused = _fused(spark, sf).join(frames(spark, sf).select("pk", "video_id"), "pk")
    return fused.select(
        "qid",
        "pk",
        "rank",
        *[F.round(F.col("per_lane")[lane], 6).alias(f"score_{lane}") for lane in ("a", "b")],
        "video_id",
    )


@query(
    "single_lane_passthrough",
    f"SELECT qid, pk, round(score, 6) AS score, round(score, 6) AS lane_score, rank FROM ({_hits_sql('b')})",
)
def single_lane_passthrough(spark, sf):
    return fusion.single_lane(_hits(spark, sf, "b"), "b").select(
        "qid", "pk", F.round("score", 6).alias("score"), F.round(F.col("per_lane")["b"], 6).alias("lane_score"), "rank"
    )


@query(
    "hits_to_submissions",
    f"""SELECT qid::VARCHAR AS task_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank,
        round(score, 6) AS score, pk AS frame_id FROM ({_hits_sql('b')}) WHERE score > 0.4""",
)
def hits_to_submissions(spark, sf):
    strong = _hits(spark, sf, "b").where(F.col("score") > 0.4)
    return fusion.to_submissions(strong).select("task_id", "rank", F.round("score", 6).alias("score"), "frame_id")


@query(
    "served_frames",
    f"""SELECT qid, rank, pk, '/thumbs/' || video_id || '/' || frame_id || '.jpg' AS thumb_url,
        '/frames/' || video_id || '/' || frame_id || '.jpg' AS full_url
      FROM ({_fused_sql()}) JOIN (SELECT pk, video_id, frame_id FROM ({lane_sql('a')})) USING (pk)""",
)
def served_frames(spark, sf):
    v, f = F.col("video_id"), F.col("frame_id")
    return _fused(spark, sf).join(frames(spark, sf).select("pk", "video_id", "frame_id"), "pk").select(
        "qid", "rank", "pk", thumb_url(v, f).alias("thumb_url"), full_url(v, f).alias("full_url")
    )


@query(
    "readiness",
    f"""SELECT count(*) AS row_count, count(*) > 0 AS collection_loaded,
        CASE WHEN bool_and(len(embedding) = 64) THEN 'a,b,c' ELSE '' END AS lanes_available FROM embeddings""",
)
def readiness(spark, sf):
    """Row count, and which lanes every frame has at its declared width."""
    e = F.col("embedding")
    widths = {"a": F.size(e), "b": F.size(F.slice(e, 1, 32)), "c": F.size(F.slice(e, 33, 32))}
    counts = {lane: F.bool_and(widths[lane] == dim) for lane, dim in LANES.items()}
    wide = table(spark, sf, "embeddings")
    stats = wide.agg(F.count(F.lit(1)).alias("row_count"), *[c.alias(f"ok_{n}") for n, c in counts.items()])
    lanes = F.array_compact(F.array(*[F.when(F.col(f"ok_{n}"), F.lit(n)) for n in LANES]))
    configured = F.array(*[F.lit(n) for n in LANES])
    return stats.select(
        "row_count",
        (F.col("row_count") > 0).alias("collection_loaded"),
        F.array_join(F.array_intersect(configured, lanes), ",").alias("lanes_available"),
    )


def _cells_of(spark: SparkSession, sf: str) -> DataFrame:
    return prototypes(spark, sf).select(F.col("qid").cast("long").alias("cell"), F.col("qvec").alias("vec"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label and half of the label's vectors: means of lane-b-positive rows."""
    docs = frames(spark, sf).withColumn("side", F.col("label") * 2 + F.when(F.col("vec")[0] >= 0, 1).otherwise(0))
    return cells.group_means(docs, "side").select(F.col("side").cast("long").alias("qid"), F.col("vec").alias("qvec"))


_ASKED_SQL = f"""SELECT qid, {unit_sql('raw')} AS qvec FROM (
    SELECT side::BIGINT AS qid, list(m ORDER BY i) AS raw FROM (
      SELECT side, i, avg(x) AS m FROM (
        SELECT label * 2 + (vec[1] >= 0)::INT AS side, unnest(vec) AS x, generate_subscripts(vec, 1) AS i
        FROM ({lane_sql('a')})) GROUP BY side, i) GROUP BY side)"""
_CELL_SQL = f"""SELECT * FROM (SELECT d.pk, d.vec, c.qid AS cell, row_number() OVER (
      PARTITION BY d.pk ORDER BY round(list_dot_product(d.vec, c.qvec), 12) DESC, c.qid) AS near
    FROM ({lane_sql('a')}) d, ({prototype_sql('a')}) c) WHERE near = 1"""
_PROBED_SQL = f"""SELECT * FROM (SELECT q.qid, q.qvec, c.qid AS cell, row_number() OVER (
      PARTITION BY q.qid ORDER BY round(list_dot_product(q.qvec, c.qvec), 12) DESC, c.qid) AS near
    FROM ({_ASKED_SQL}) q, ({prototype_sql('a')}) c) WHERE near <= {PROBES}"""
_APPROX_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pk) AS rank FROM (
      SELECT q.qid, d.pk, round(list_dot_product(q.qvec, d.vec), 12) AS score
      FROM ({_PROBED_SQL}) q JOIN ({_CELL_SQL}) d USING (cell))) WHERE rank <= {TOP}"""
_EXACT_SQL = topk_sql(_ASKED_SQL, f"SELECT pk, vec FROM ({lane_sql('a')})", TOP)


def _approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Search over an index in files: half of the frames first, the others appended."""
    docs = frames(spark, sf).select("pk", "vec", (F.col("vec_id") % 2 == 0).alias("first"))
    store = cells.StoredCells.create(docs.where("first").drop("first"), _cells_of(spark, sf), scratch_path(spark, "index"))
    store.append(docs.where("NOT first").drop("first"))
    return store.search(_asked(spark, sf), TOP, PROBES)


@query("cell_assignment", f"SELECT cell, count(*) AS n, min(pk) AS first_pk FROM ({_CELL_SQL}) GROUP BY cell")
def cell_assignment(spark, sf):
    index = cells.assign_cells(frames(spark, sf), _cells_of(spark, sf))
    return index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("pk").alias("first_pk"))


@query("ann_topk", f"SELECT qid, pk, round(score, 6) AS score, rank FROM ({_APPROX_SQL})")
def ann_topk(spark, sf):
    return _approximate(spark, sf).select("qid", "pk", F.round("score", 6).alias("score"), "rank")


@query(
    "ann_recall_vs_exact",
    f"""WITH e AS ({_EXACT_SQL}), a AS ({_APPROX_SQL}), cut AS (SELECT qid, min(score) AS tau FROM e GROUP BY qid)
      SELECT cut.qid, (SELECT count(*) FROM a JOIN e USING (qid, pk) WHERE a.qid = cut.qid) / {TOP}.0::DOUBLE AS recall_set,
        (SELECT count(*) FROM a WHERE a.qid = cut.qid AND a.score >= tau - 1e-5) / {TOP}.0::DOUBLE AS recall_score FROM cut""",
)
def ann_recall_vs_exact(spark, sf):
    exact = search.top_k(frames(spark, sf), _asked(spark, sf), TOP, dim=LANES["a"])
    return cells.recall_against_exact(_approximate(spark, sf), exact, TOP)


def _tokens(v):
    return F.array(*[F.slice(v, 1 + 16 * i, 16) for i in range(4)])


def _dot16(i: int, j: int) -> str:
    a, b = 16 * i, 16 * j
    return f"list_dot_product(q.qvec[{a + 1}:{a + 16}], d.vec[{b + 1}:{b + 16}])"


_MAXSIM = "(" + " + ".join(f"greatest({', '.join(_dot16(i, j) for j in range(4))})" for i in range(4)) + ") / 4"


@query(
    "maxsim_late_interaction",
    f"""SELECT qid, pk, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pk) AS rank FROM (
        SELECT q.qid, d.pk, round({_MAXSIM}, 12) AS score FROM ({prototype_sql('a')}) q, ({lane_sql('a')}) d))
      WHERE rank <= {TOP}""",
)
def maxsim_late_interaction(spark, sf):
    """Vectors seen as four tokens of width 16."""
    docs = frames(spark, sf).select("pk", _tokens(F.col("vec")).alias("vec"))
    asked = prototypes(spark, sf).select("qid", _tokens(F.col("qvec")).alias("qvec"))
    hits = search.top_k(docs, asked, TOP, scorer="late_interaction")
    return hits.select("qid", "pk", F.round("score", 6).alias("score"), "rank")


HEAD_IN, HEAD_OUT = 16, 8


def _head_weights(prototypes_: DataFrame) -> DataFrame:
    """A head of two layers, cut from the mean vectors of the labels."""
    numbered = prototypes_.select(F.col("qid").cast("int").alias("unit"), "qvec")
    layers = [(0, 1, HEAD_IN, 40), (1, 21, 10, 50)]
    parts = [
        numbered.select(F.lit(layer).alias("layer"), "unit", F.slice("qvec", at, width).alias("weights"), F.col("qvec")[bias - 1].alias("bias"))
        for layer, at, width, bias in layers
    ]
    return parts[0].unionByName(parts[1].where(F.col("unit") < HEAD_OUT))


_ERF_T = f"(1 / (1 + {heads.ERF_P} * abs(x / sqrt(2.0))))"


def _erf_sql() -> str:
    series = "0.0::DOUBLE"
    for a in reversed(heads.ERF_A):
        series = f"(({series} + {a}::DOUBLE) * t)"
    return f"sign(x) * (1 - {series} * exp(-(x / sqrt(2.0)) * (x / sqrt(2.0))))"


@query(
    "projection_head",
    f"""WITH heads AS MATERIALIZED ({prototype_sql('a')}),
      tokens AS (SELECT pk, k, vec[16 * k + 1:16 * k + 16] AS v FROM ({lane_sql('a')}), range(0, 4) AS r(k)),
      hidden AS (SELECT pk, k, qid AS unit, list_dot_product(v, qvec[1:{HEAD_IN}]) + qvec[40] AS x FROM tokens, heads),
      active AS (SELECT pk, k, list(g ORDER BY unit) AS h FROM (
        SELECT pk, k, unit, x * 0.5 * (1 + {_erf_sql()}) AS g FROM (SELECT *, {_ERF_T} AS t FROM hidden)) GROUP BY pk, k),
      projected AS (SELECT pk, k, list(list_dot_product(h, qvec[21:30]) + qvec[50] ORDER BY qid) AS o FROM active, heads WHERE qid < {HEAD_OUT} GROUP BY pk, k)
      SELECT pk, k AS token, round(list_sum(u), 6) AS total, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(list_dot_product(u, [{", ".join(f"{i + 1}.0::DOUBLE" for i in range(HEAD_OUT))}]), 6) AS slanted
      FROM (SELECT pk, k, {unit_sql('o')} AS u FROM projected)""",
)
def projection_head(spark, sf):
    """Every vector as four tokens, through a head whose weights are a table."""
    head = heads.ProjectionHead(_head_weights(prototypes(spark, sf)))
    out = frames(spark, sf).select("pk", F.posexplode(head.forward(_tokens(F.col("vec")))).alias("token", "u"))
    slant = F.array(*[F.lit(float(i + 1)) for i in range(HEAD_OUT)])
    return out.select(
        "pk",
        F.col("token").cast("long").alias("token"),
        F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.round(V.norm(F.col("u")), 6).alias("norm"),
        F.round(V.dot(F.col("u"), slant), 6).alias("slanted"),
    )
