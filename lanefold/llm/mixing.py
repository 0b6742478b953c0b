"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents is to be taken
on average; whole copies are certain, and the rest is a probability. Two documents with open
probabilities p, q and sizes a, b meet: words are moved from one to the other until one of them is
taken for certain or left out, in the direction that a coin chooses such that neither expectation changes.
p * a + q * b stays, so that a source's taken words miss its target by less than the one
document that is left over at the end and rounded by a coin of its own.

That one is to be small. So the largest open document goes first and meets as many of the next
smaller ones at once as it takes to settle it, each giving or taking a share that it can bear in
both directions; only where all the smaller ones together can't bear it does it meet them one by one.

Documents of a source are dealt by hash into blocks of some ``BLOCK``, which leave one open document each at
most; what is left over meets in blocks of blocks, level by level, until there is one per source. A task
holds one block at a time, and a source with a third of all rows has many.

Size: runs of anything but the six ASCII white-space characters. Null and empty texts have none and
are taken 0 times. Equal rows (id, source, size) are rounded together and share what
they get as evenly as whole copies allow. Coins are hashes of id, size, source and level: reruns agree,
wherever rows are. Sources without any words have the target 0. A null source is a
source of its own, the last one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, releasing, stored
from lanefold.operators.sizing import dense_ordinal
from lanefold.session import scratch_path

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK, FAN = 2_048, 256
TOGETHER = 1_024
SEED = 5
SETTLED = 1e-12


def sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, n): how many rows there are of each kind."""
    rows = own_columns(docs, doc_id="doc_id", source="source", text="text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return rows.select("source", "doc_id", words.alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))


def targets(items: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(src, source, source_size, target, blocks) of each source; they share all words by weight, up to ``repeats`` times their own.

    The level, words per weight, rises until no source that stays below its bound is above it
    any more; only sums reach the driver.
    """
    weigh = F.array(*[F.lit(w).cast("long") for w in weights])
    each = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("_items")
    )
    each = stored(each.withColumn("_last", F.col("source").isNull()), "sources")
    placed = dense_ordinal(each, [], ["_last", "source"], "src")
    placed = placed.withColumn("weight", F.element_at(weigh, (F.col("src") % len(weights) + 1).cast("int")))
    placed = stored(placed, "sources")
    bound = repeats * F.col("source_size")

    def below(level: float) -> tuple[int, int, int]:
        capped = bound < level * F.col("weight")
        sums = [F.count_if(capped), F.sum(F.when(capped, bound).otherwise(0)), F.sum(F.when(capped, F.col("weight")).otherwise(0))]
        return tuple(v or 0 for v in placed.agg(*sums).first())

    total, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (weight or 1), 0
    while True:
        n, words, weighing = below(level)
        if n == capped or weighing == weight:
            break
        level, capped = (total - words) / (weight - weighing), n
    target = F.least(bound.cast("double"), F.lit(float(level)) * F.col("weight"))
    blocks = F.greatest(F.ceil(F.col("_items") / BLOCK), F.lit(1)).cast("long")
    return placed.select("src", "source", "source_size", target.alias("target"), blocks.alias("blocks"))


def meet(p: float, a: int, q: float, b: int, coin: float) -> tuple[float, float]:
    """New probabilities of two open documents of ``a`` and ``b`` words, one of them 0 or 1."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if coin * (up + down) < down:
        return (1.0, q - up / b) if up == (1 - p) * a else (p + up / a, 0.0)
    return (0.0, q + down / b) if down == p * a else (p - down / a, 1.0)


def _open(p: float) -> bool:
    return SETTLED < p < 1 - SETTLED


def settle(p: list[float], sizes: list[int], coins: list[float], pair_coins: list[float]) -> None:
    """Settles all of ``p`` but one at most, in place; sizes are in falling order."""
    for i, a in enumerate(sizes):
        if not _open(p[i]):
            continue
        partners, shares, total = [], [], 0.0
        for j in range(i + 1, len(p)):
            if _open(p[j]):
                # The part of i's move, to either end, that j can bear.
                partners.append(j)
                shares.append(min(p[j] * sizes[j] / ((1 - p[i]) * a), (1 - p[j]) * sizes[j] / (p[i] * a)))
                total += shares[-1]
                if total >= 1:
                    break
        if total >= 1:
            taken = coins[i] < p[i]
            moved = -(1 - p[i]) * a if taken else p[i] * a
            p[i] = 1.0 if taken else 0.0
            for j, share in zip(partners, shares):
                p[j] = min(1.0, max(0.0, p[j] + share / total * moved / sizes[j]))
            continue
        for j in partners:
            p[i], p[j] = meet(p[i], a, p[j], sizes[j], (pair_coins[i] + pair_coins[j]) % 1.0)
            if not _open(p[i]):
                break


def _level(rows: DataFrame, level: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Documents that are settled by a level, and those left over; none is if it is the ``last``."""
    names = ["src", "block", "doc_id", "size", "n", "copies", "p"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", left boolean"

    def finished(block: pa.Table) -> pa.RecordBatch:
        p, copies, ends = (block.column(c).to_pylist() for c in ("p", "copies", "end"))
        settle(p, *[block.column(c).to_pylist() for c in ("size", "coin", "pair")])
        if last:
            p = [float(end < x) if _open(x) else x for x, end in zip(p, ends)]
        left = [_open(x) for x in p]
        copies = [c + (0 if more else round(x)) for c, x, more in zip(copies, p, left)]
        columns = [block.column(c).combine_chunks() for c in names[:5]]
        p = pa.array([x if more else 0.0 for x, more in zip(p, left)])
        return pa.record_batch([*columns, pa.array(copies, pa.int64()), p, pa.array(left)], [*names, "left"])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            src, block = (batch.column(c).to_numpy() for c in ("src", "block"))
            cuts = (np.flatnonzero((src[1:] != src[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, end - start)
                if held and (held[0].column("src")[0], held[0].column("block")[0]) != (part.column("src")[0], part.column("block")[0]):
                    yield finished(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield finished(pa.Table.from_batches(held))

    chance = lambda use: F.xxhash64(F.lit(SEED), F.lit(use), F.lit(level), "src", "doc_id", "size") / F.lit(2.0**64) + F.lit(0.5)
    dealt = rows.select(*names, *[chance(c).alias(c) for c in ("coin", "pair", "end")]).repartition("src", "block")
    dealt = dealt.sortWithinPartitions("src", "block", F.desc("size"), "coin", "doc_id")
    path = scratch_path(rows.sparkSession, "rounded")
    dealt.mapInArrow(work, schema).write.parquet(path)
    done = rows.sparkSession.read.schema(schema).parquet(path)
    return done.where("NOT left").drop("left"), done.where("left").drop("left")


def rounded(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, doc_id, size, n, copies): how many copies the ``n`` rows of each kind get together."""
    rows = items.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    due = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    block = F.pmod(F.xxhash64("doc_id", "size"), "blocks")
    rows = rows.select("src", block.alias("block"), "doc_id", "size", "n", due.alias("_due"))
    rows = rows.select("src", "block", "doc_id", "size", "n", F.floor("_due").alias("copies"), (F.col("_due") - F.floor("_due")).alias("p"))
    blocks = sources.agg(F.max("blocks")).first()[0] or 1
    level, parts = 0, []
    while True:
        done, left = _level(rows, level, last=blocks == 1)
        parts.append(done)
        if blocks == 1:
            break
        rows, level, blocks = left.withColumn("block", F.floor(F.col("block") / FAN)), level + 1, -(-blocks // FAN)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("src", "doc_id", "size", "n", "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document, ``taken`` in words."""
    items = stored(sizes(docs), "sizes")
    sources = stored(targets(items, weights, repeats), "targets")
    kinds = rounded(items, sources).withColumnRenamed("src", "_src").join(sources, F.col("_src") == F.col("src"))
    kinds = kinds.select("doc_id", "source", "size", "source_size", "target", "n", "copies")
    # Back to rows; a kind of very many goes to several tasks first.
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TOGETHER))).alias("_run")
    many = kinds.where(F.col("n") > TOGETHER).select("*", runs).repartition("doc_id", "source", "size", "_run")
    each = kinds.where(F.col("n") <= TOGETHER).select("*", F.lit(0).cast("long").alias("_run")).unionByName(many)
    start = F.col("_run") * TOGETHER
    each = each.select("*", F.explode(F.sequence(start, F.least(start + TOGETHER, F.col("n")) - 1)).alias("_i"))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("_i") < F.col("copies") % F.col("n")).cast("long")
    each = each.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"))
    return each.withColumn("taken", F.col("copies") * F.col("size"))
