"""String leaves of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LEAF = 4

# A JSON string and, if it is a key, the colon after it. Possessive, so that a long string
# costs no stack and a key is never taken up again from its closing quote.
_STRING = r'"((?:[^"\\]++|\\.)*+)"(\s*+:)?+'


def is_json(x: Column) -> Column:
    """Whether ``x`` is one whole JSON value. Parsers alone overlook text after the value."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1, F.lit(False))


def string_leaves(json: Column, min_chars: int = MIN_LEAF) -> Column:
    """All string values at any depth, in document order, of at least ``min_chars`` characters.

    Keys are not values. A malformed document has none.
    """
    bodies = F.regexp_extract_all(json, F.lit(_STRING), 1)
    colons = F.regexp_extract_all(json, F.lit(_STRING), 2)
    both = F.arrays_zip(bodies.alias("body"), colons.alias("colon"))
    values = F.filter(both, lambda s: s["colon"] == "")
    texts = F.transform(
        values,
        lambda s: F.when(
            F.contains(s["body"], F.lit("\\")),
            F.get(F.from_json(F.concat(F.lit('["'), s["body"], F.lit('"]')), "array<string>"), F.lit(0)),
        ).otherwise(s["body"]),
    )
    leaves = F.filter(texts, lambda t: F.char_length(t) >= min_chars)
    return F.when(is_json(json), leaves).otherwise(F.array().cast("array<string>"))
