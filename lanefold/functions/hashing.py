"""Content-keyed randomness.

Every random choice is a pure function of a key string and a position, so a result depends
neither on partitioning nor on the order of rows, and a lost task recomputes the same rows.
The arithmetic stays below 2**63, which lets NumPy, Spark and plain SQL agree exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def key_hash(key: str) -> int:
    return int(hashlib.md5(key.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)


def key_hash_col(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def uniforms(h: np.ndarray, stream: int, i: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1): one per (hash, position) pair of the given stream."""
    h = h.astype(np.int64)
    i = i.astype(np.int64)
    x = (h + stream * 101390422 + i * 69621) % MODULUS
    x = (x * x + h + i) % MODULUS
    x = (x * 48271) % MODULUS
    x = (x * x + stream * 97 + i) % MODULUS
    x = (x * 69621) % MODULUS
    return x / MODULUS


def uniform_col(h: Column, stream: int, i: Column) -> Column:
    """The same numbers as a column expression."""
    m = F.lit(MODULUS).cast("long")
    i = i.cast("long")
    x = (h + F.lit(stream * 101390422).cast("long") + i * F.lit(69621).cast("long")) % m
    x = (x * x + h + i) % m
    x = (x * F.lit(48271).cast("long")) % m
    x = (x * x + F.lit(stream * 97).cast("long") + i) % m
    x = (x * F.lit(69621).cast("long")) % m
    return x / F.lit(float(MODULUS))


def wide_key_col(key: Column) -> Column:
    """Sixty bits of the key's digest."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


PERMUTATION_ROUNDS = 12  # with fewer, two slots among some ten strings are not yet independent
HALF_KEY = 1 << 30


def permutation_sides(n: int) -> tuple[int, int]:
    """Two factors, nearly equal, whose product is at least ``n`` and less than ``n`` and the larger one more."""
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def permuted_col(x: Column, key: Column, n: int) -> Column:
    """Where a permutation of 0 to n - 1, one for every key of 60 bits, sends ``x``.

    A Feistel network over pairs of digits; a place beyond n - 1 is sent on until it lies
    below. Fewer than sqrt(n) + 1 places are beyond, so hardly any is sent on twice.
    """
    a, b = (F.lit(v).cast("long") for v in permutation_sides(n))
    beyond = math.prod(permutation_sides(n)) - n
    m = F.lit(MODULUS).cast("long")
    high, low = F.shiftright(key, 30), key % HALF_KEY

    def stirred(v: Column, i: Column) -> Column:
        t = (v * F.lit(69621).cast("long") + high + i * F.lit(101390422).cast("long")) % m
        return ((t * t + low + i) % m) * F.lit(48271).cast("long") % m

    def turn(at: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (at["l"] + stirred(at["r"], i)) % a).otherwise(at["l"])
        right = F.when(i % 2 == 1, (at["r"] + stirred(at["l"], i)) % b).otherwise(at["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def once_through(v: Column) -> Column:
        turns = F.sequence(F.lit(0).cast("long"), F.lit(PERMUTATION_ROUNDS - 1).cast("long"))
        start = F.struct(((v - v % b) / b).cast("long").alias("l"), (v % b).alias("r"))
        return F.aggregate(turns, start, turn, lambda at: at["l"] * b + at["r"])

    found = once_through(x.cast("long"))
    if not beyond:
        return found
    again = F.sequence(F.lit(1), F.lit(min(beyond, 64)))
    return F.aggregate(again, found, lambda v, _: F.when(v < n, v).otherwise(once_through(v)))


def beta_2_5(h: np.ndarray, stream: int) -> np.ndarray:
    """One Beta(2, 5) draw per hash: the second smallest of six uniforms."""
    draws = np.stack([uniforms(h, stream, np.full_like(h, j)) for j in range(6)])
    return np.sort(draws, axis=0)[1]
