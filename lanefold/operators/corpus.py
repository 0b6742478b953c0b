"""Clean strings, held-out strings, negatives and noisy pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.functions import noise as N
from lanefold.functions.hashing import permuted_col, wide_key_col
from lanefold.functions.text import (
    MIN_CHARS,
    casefold,
    collapse_spaces,
    dedup_key,
    is_blank,
    looks_like_prose,
    sentences,
)
from lanefold.operators.sizing import dense_ordinal, spread, written


def row_strings(
    df: DataFrame,
    order: str,
    fields: Sequence[str] = (),
    split: bool = False,
) -> DataFrame:
    """(order, part, text): the strings of each row, from ``fields`` or from every prose-like column.

    Columns may be strings or arrays of strings. ``part`` numbers the strings of a row.
    """
    kinds = dict(df.dtypes)
    chosen = list(fields) or [c for c, t in df.dtypes if c != order and t in ("string", "array<string>")]
    arrays = []
    for name in chosen:
        if kinds.get(name) == "string":
            values = F.array(F.col(name))
        elif kinds.get(name) == "array<string>":
            values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        else:
            continue
        values = F.filter(values, lambda s: s.isNotNull())
        arrays.append(values if fields else F.filter(values, lambda s: looks_like_prose(s)))
    if not arrays:
        raise ValueError("no string columns to read")
    strings = F.concat(*arrays)
    strings = F.flatten(F.transform(strings, lambda s: sentences(s))) if split else F.filter(strings, lambda s: ~is_blank(s))
    return df.select(order, F.posexplode(strings).alias("part", "text"))


def first_spellings(
    df: DataFrame, text: str, order: Sequence[str], min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per string, case and spacing aside: the first one in ``order``, normalised.

    One pass, one shuffle: copies are combined on the map side by a digest of their key, so
    a text that makes up any share of the rows costs one row per task. ``order`` must be unique.
    """
    base = df.where(F.col(text).isNotNull()).withColumn(text, collapse_spaces(F.col(text)))
    base = base.where(F.char_length(text) >= min_chars)
    return _first_of(base, F.sha2(casefold(F.col(text)), 256), order)


def _first_of(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def append_missing(base: DataFrame, extra: DataFrame, text: str, order: str) -> DataFrame:
    """Distinct non-blank strings of ``base``, then those of ``extra`` that are not among them."""
    tagged = base.select(F.lit(0).alias("source"), F.col(order).alias("ord"), F.col(text).alias("text")).where(
        ~is_blank(F.col("text"))
    ).unionByName(
        extra.select(F.lit(1).alias("source"), F.col(order).alias("ord"), F.col(text).alias("text"))
    )
    return _first_of(tagged, F.sha2("text", 256), ["source", "ord"])


def held_out(clean: DataFrame, training: DataFrame, text: str = "text", anchor: str = "text") -> DataFrame:
    """Clean strings whose key is no training anchor's. ``clean`` has no copies (``first_spellings``)."""
    seen = training.select(F.sha2(dedup_key(F.col(anchor)), 256).alias("_key")).distinct()
    keyed = clean.withColumn("_key", F.sha2(dedup_key(F.col(text)), 256))
    return keyed.join(seen, "_key", "left_anti").drop("_key")


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random sort key per row, the same wherever the row is."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a random order that only depends on ``seed`` and ``key``."""
    if n <= 0:
        raise ValueError(f"n must be positive; got {n}")
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def hard_negatives(
    clean: DataFrame,
    n: int,
    seed: int = 0,
    *,
    text: str = "text",
    order: str = "ord"
) -> DataFrame:
    """(ord, slot, negative): up to ``n`` distinct other strings per anchor.

    Strings are numbered. Each anchor has its own random permutation of 0 to N - 2, and its slot j
    takes string ``i + 1 + permutation(j)`` modulo N: never itself, never one twice, and one slot
    tells nothing of another.
    """
    clean = written(clean.select(order, text), "clean")  # numbered, counted and joined below
    return _negatives(clean, n, seed, text, order)


def _negatives(
    clean: DataFrame, n: int, seed: int, text: str, order: str
) -> DataFrame:
    numbered = dense_ordinal(clean, [], [order], "idx")
    total = clean.count()
    take = min(n, total - 1)
    if take <= 0:
        return numbered.select(order, F.lit(0).alias("slot"), F.col(text).alias("negative")).limit(0)
    key = wide_key_col(F.concat(F.lit(f"{seed}|hardnegs|"), F.col("idx").cast("string")))
    asks = numbered.select(order, "idx", key.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(take - 1))).alias("slot"))
    away = permuted_col(F.col("slot"), F.col("key"), total - 1)
    asks = asks.select(order, "slot", ((F.col("idx") + 1 + away) % F.lit(total)).alias("idx"))
    return asks.join(numbered.select("idx", F.col(text).alias("negative")), "idx").select(
        order, "slot", "negative"
    )


def negatives_array(negatives: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, hard_negs): the bounded list of negatives per anchor, by slot."""
    return negatives.groupBy(order).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("slot", "negative"))), lambda s: s["negative"]
        ).alias("hard_negs")
    )


def contrastive_pairs(
    clean: DataFrame,
    *,
    k: int | None = None,
    hard_negatives_per_anchor: int = 7,
    seed: int = 0,
    text: str = "text",
    order: str = "ord",
    told_by: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """(ord, variant, anchor_clean, positive_noisy, mode, hard_negs) from de-duplicated strings.

    ``told_by`` is what anchors and negatives are given as, such as a digest: it is taken once per string,
    before strings meet as negatives and before each is repeated for its variants.
    """
    N.cycle(k)
    clean = written(clean.select(order, text, told_by(F.col(text)).alias("_told")), "anchors")
    told = clean.select(order, F.col("_told").alias(text))
    negs = negatives_array(_negatives(told, hard_negatives_per_anchor, seed, text, order), order)
    # Negatives are joined to the anchors, not to their many variants.
    anchors = spread(clean).join(negs, order, "left").withColumn(
        "hard_negs", F.coalesce("hard_negs", F.array().cast("array<string>"))
    )
    return anchors.select(
        order, F.col("_told").alias("anchor_clean"), "hard_negs", F.inline(N.variants(F.col(text), k, seed))
    ).select(order, "variant", "anchor_clean", F.col("noisy").alias("positive_noisy"), "mode", "hard_negs")


def union_sources(named: Sequence[tuple[str, object]]) -> tuple[DataFrame | None, list[str], list[str]]:
    """(rows, used, skipped): sources in order, those that fail or are empty left out.

    Each source is a name and a function returning a DataFrame of (ord, text). A source is written to
    a folder of its own and counts only once that is complete: one that fails in its last file
    leaves nothing behind among the others. Faults of the program itself are not caught.
    """
    used, skipped, frames = [], [], []
    for i, (name, load) in enumerate(named):
        try:
            staged = written(load().select(F.lit(i).alias("source_ord"), "ord", "text"), "source")
        except (PySparkException, Py4JJavaError, OSError):
            skipped.append(name)
            continue
        if staged.isEmpty():
            skipped.append(name)
            continue
        used.append(name)
        frames.append(staged)
    rows = reduce(DataFrame.unionByName, frames) if frames else None
    return rows, used, skipped


def cap_source(df: DataFrame, order: str, size: Column, cap: int) -> DataFrame:
    """Whole rows until the running total of ``size`` reaches ``cap``; the last one may overshoot."""
    from lanefold.operators.sizing import running_total

    summed = running_total(df, [], [order], "_through", size)
    return summed.where(F.col("_through") - size < cap).drop("_through")


