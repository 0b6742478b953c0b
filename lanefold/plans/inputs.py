"""The engine's relations, read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.identifiers import compose_pk
from lanefold.functions.vectors import truncate
from lanefold.operators.cells import group_means
from lanefold.operators.sizing import spread

LANES = {"a": 64, "b": 32, "c": 32}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table of texts, over enough tasks for costly work on each."""
    return spread(table(spark, sf, name))


def frames(spark: SparkSession, sf: str, lane: str = "a") -> DataFrame:
    """(vec_id, pk, video_id, frame_id, vec): one lane of the keyframes.

    Lane a is the whole vector, b its first half and c its second half at unit length.
    """
    e = F.col("embedding")
    vec = {
        "a": e,
        "b": truncate(e, LANES["b"]),
        "c": truncate(F.slice(e, LANES["b"] + 1, LANES["c"]), LANES["c"]),
    }[lane]
    video, frame = F.concat(F.lit("L"), F.col("label")), F.format_string("%06d", "vec_id")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        compose_pk(video, frame).alias("pk"),
        video.alias("video_id"),
        frame.alias("frame_id"),
        "label",
        vec.alias("vec"),
    )


def lane_vectors(spark: SparkSession, sf: str, lanes=("a", "b", "c")) -> DataFrame:
    """(lane, video_id, frame_id, vec_id, vec): all lanes as one long relation."""
    out = None
    for lane in lanes:
        part = frames(spark, sf, lane).select(
            F.lit(lane).alias("lane"), "video_id", "frame_id", "vec_id", "vec"
        )
        out = part if out is None else out.unionByName(part)
    return out


def prototypes(spark: SparkSession, sf: str, lane: str = "a") -> DataFrame:
    """(qid, qvec): the unit mean vector of each label, used as query."""
    return group_means(frames(spark, sf, lane), "label").select(
        F.col("label").cast("long").alias("qid"), F.col("vec").alias("qvec")
    )


# The same relations in SQL.
UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def unit_sql(v: str) -> str:
    return UNIT.format(v=v)


def lane_sql(lane: str) -> str:
    e = "embedding::DOUBLE[]"
    vec = {
        "a": e,
        "b": unit_sql(f"({e})[1:32]") + "::FLOAT[]::DOUBLE[]",
        "c": unit_sql(f"({e})[33:64]") + "::FLOAT[]::DOUBLE[]",
    }[lane]
    return f"""SELECT vec_id, 'L' || label || '_' || printf('%06d', vec_id) AS pk, 'L' || label AS video_id,
        printf('%06d', vec_id) AS frame_id, label, {vec} AS vec FROM embeddings"""


def prototype_sql(lane: str) -> str:
    return f"""SELECT qid, {unit_sql('raw')} AS qvec FROM (
        SELECT label::BIGINT AS qid, list(m ORDER BY i) AS raw FROM (
          SELECT label, i, avg(x) AS m FROM (
            SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM ({lane_sql(lane)}))
          GROUP BY label, i) GROUP BY label)"""


def topk_sql(queries: str, docs: str, k: int, where: str = "TRUE", key: str = "pk") -> str:
    """Exact top-k of every query, equal scores by key."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS rank
        FROM (SELECT q.qid, d.* EXCLUDE (vec), round(list_dot_product(q.qvec, d.vec), 12) AS score
              FROM ({queries}) q, ({docs}) d WHERE {where})) WHERE rank <= {k}"""
