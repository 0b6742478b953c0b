"""Perspective rotation: each dialogue once for every participant.

For a participant, the dialogue is rendered with that speaker's turns as ``assistant`` and all
others as ``user`` under their names; system turns stay as they are and take no perspective of
their own. The mask covers what the assistant says, end mark included, so that a model learns
to speak as that participant only.

Column functions only. A dialogue is never gathered in one task: turns get their place in the text
from a running total that splits hot dialogues over ranges, and the text is put together in
shards of some ``SHARD_CHARS`` characters. All but very long dialogues are one shard.

Turns go by number (nulls first), then speaker, then digest of the text; a turn given several
times is rendered as often, as a repeated row cannot be told from a repeated utterance. A null role is the speaker ``unknown``; a null text is empty; a null
conv_id is a dialogue like any other. Names lose the characters that would end a header, texts
that imitate a control mark get a space within it. A dialogue of system turns only has no
participant and gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns
from lanefold.operators.sizing import running_total

SHARD_CHARS = 1 << 20
COPIES = 4096
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def _header(view: Column, speaker: Column) -> Column:
    return (
        F.when(speaker == SYSTEM, F.lit(f"{START}{SYSTEM}\n"))
        .when(speaker == view, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n")))
    )


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, speaker, digest, text, copies): one row per different turn, cleaned, and how often it occurs."""
    rows = own_columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    speaker = F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"[\r\n<>|]", "_")
    return (
        rows.select("conv_id", "turn", speaker.alias("speaker"), F.md5(text).alias("digest"), text.alias("text"))
        .groupBy("conv_id", "turn", "speaker", "digest")
        .agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    )


def each_copy(rows: DataFrame) -> DataFrame:
    """A row with its ``copy`` number for each of ``copies``, counted out in two steps to keep lists short."""
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    first, left = F.col("_some") * COPIES, F.col("copies") - F.col("_some") * COPIES - 1
    one = F.explode(F.sequence(first, first + F.least(left, F.lit(COPIES - 1))))
    return rows.withColumn("_some", some).withColumn("copy", one).drop("_some", "copies")


def rotate(conversations: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(conv_id, view, shard, text, n_turns, loss_spans, loss_chars) for every dialogue and participant.

    ``loss_spans`` are (start, end) in characters of ``text``, in order.
    """
    said = turns(conversations)
    short = said.select("conv_id", "turn", "speaker", "digest", "copies", F.length("text").alias("size"))
    views = (
        short.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("view")).distinct()
    )
    seen = each_copy(short.join(views, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
    whole = F.length(_header(F.col("view"), F.col("speaker"))) + F.col("size") + len(END) + 1
    placed = running_total(
        seen.withColumn("size", whole.cast("long")), ["conv_id", "view"], ["turn", "speaker", "digest", "copy"], "through", F.col("size")
    ).select(
        F.col("conv_id").alias("_conv"),
        F.col("turn").alias("_turn"),
        F.col("speaker").alias("_speaker"),
        F.col("digest").alias("_digest"),
        "view",
        (F.col("through") - F.col("size")).alias("start"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{k}")) for c, k in zip(("conv_id", "turn", "speaker", "digest"), ("conv", "turn", "speaker", "digest"))]
    part = F.struct(
        "start",
        (F.col("speaker") == F.col("view")).alias("own"),
        F.length(_header(F.col("view"), F.col("speaker"))).cast("long").alias("head"),
        F.concat(_header(F.col("view"), F.col("speaker")), "text", F.lit(END + "\n")).alias("text"),
    )
    shards = (
        said.join(placed, same[0] & same[1] & same[2] & same[3])
        .groupBy("conv_id", "view", F.floor(F.col("start") / shard_chars).alias("shard"))
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
    )
    first = F.get("parts", F.lit(0))["start"]
    own = F.filter("parts", lambda p: p["own"])
    spans = F.transform(
        own,
        lambda p: F.struct(
            (p["start"] - first + p["head"]).alias("start"),
            (p["start"] - first + F.length(p["text"]) - 1).alias("end"),
        ),
    )
    return shards.select(
        "conv_id",
        "view",
        "shard",
        F.array_join(F.col("parts.text"), "").alias("text"),
        F.size("parts").cast("long").alias("n_turns"),
        spans.alias("loss_spans"),
    ).withColumn(
        "loss_chars", F.aggregate("loss_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    )


def rotated(conversations: DataFrame) -> DataFrame:
    """``rotate`` with the spans written as text, ``start-end`` with commas between."""
    spans = F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return rotate(conversations).withColumn("loss_spans", F.array_join(spans, ","))


_HEAD = f"""CASE WHEN speaker = '{SYSTEM}' THEN '{START}{SYSTEM}' || chr(10) WHEN speaker = view THEN '{START}assistant' || chr(10)
            ELSE '{START}user name=' || speaker || chr(10) END"""

ROTATED_SQL = f"""
WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[\\r\\n<>|]', '_', 'g') AS speaker,
                  replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS view FROM t WHERE speaker <> '{SYSTEM}'),
h AS (SELECT t.*, view, {_HEAD} AS head FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
p AS (SELECT *, head || text || '{END}' || chr(10) AS part FROM h),
s AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id, view ORDER BY turn NULLS FIRST, speaker, md5(text) ROWS UNBOUNDED PRECEDING) - length(part) AS start FROM p),
g AS (SELECT *, (start // {SHARD_CHARS})::BIGINT AS shard FROM s),
f AS (SELECT *, min(start) OVER (PARTITION BY conv_id, view, shard) AS first FROM g)
SELECT conv_id, view, shard, string_agg(part, '' ORDER BY start) AS text, count(*)::BIGINT AS n_turns,
       coalesce(string_agg((start - first + length(head))::BIGINT || '-' || (start - first + length(part) - 1)::BIGINT, ',' ORDER BY start)
                FILTER (speaker = view), '') AS loss_spans,
       coalesce(sum(length(part) - 1 - length(head)) FILTER (speaker = view), 0)::BIGINT AS loss_chars
FROM f GROUP BY conv_id, view, shard"""
