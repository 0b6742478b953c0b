"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 1e-3
EPS = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, element: str = "float") -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(EPS))
    return F.transform(as_double(v), lambda x: x / length).cast(f"array<{element}>")


def truncate(v: Column, dim: int, element: str = "float") -> Column:
    """The first ``dim`` components, back at unit length."""
    if dim < 1:
        raise ValueError(f"dim must be positive; got {dim}")
    return l2_normalise(F.slice(v, 1, dim), element)


def norm_deviation(v: Column) -> Column:
    return F.abs(norm(v) - 1.0)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def checked_width(v: Column, dim: int, label: str) -> Column:
    """The vector itself; an error where its width is not ``dim``."""
    return F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"dim mismatch for field '{label}': expected dim {dim}, actual "),
                F.size(v).cast("string"),
            )
        )
    )
