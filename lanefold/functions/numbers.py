"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1 halves a double's digits


def round_half_even(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, halves to even.

    ``bround`` rounds the shortest decimal form instead, and so takes 281.225 for a tie,
    which it is not. The error of the scaled product is computed exactly and settles ties.
    """
    scale = 10.0**digits
    scale_hi = scale * _SPLIT - (scale * _SPLIT - scale)
    scale_lo = scale - scale_hi
    x = x.cast("double")
    product = x * scale
    hi = x * _SPLIT - (x * _SPLIT - x)
    lo = x - hi
    error = ((hi * scale_hi - product) + hi * scale_lo + lo * scale_hi) + lo * scale_lo
    whole = F.floor(product)
    past_half = product - whole - 0.5
    up = (past_half > 0) | (
        (past_half == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1)))
    )
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / scale
