"""Text functions as native column expressions.

Character classes follow Python's string predicates; they are derived from the Unicode
database once, when the module loads, and handed to the JVM as regular expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CHARS = 4
LAST = 0x1FFFF  # nothing beyond has case, marks on letters, or digits
SENTENCE_MIN, SENTENCE_MAX = 15, 300
PROSE_MIN = 15

# Java's Unicode \s leaves out the four separators U+001C..U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def _class_of(predicate) -> str:
    """A regular-expression class body holding every code point that satisfies ``predicate``."""
    ranges: list[list[int]] = []
    for cp in range(LAST + 1):
        if 0xD800 <= cp <= 0xDFFF or not predicate(chr(cp)):
            continue
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(
        f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges
    )


def carries_mark(ch: str) -> bool:
    """True for a letter that decomposes into a base and a combining mark, and for the d with stroke."""
    if ch in "đĐ":
        return True
    return ch.isalpha() and any(
        unicodedata.combining(part) for part in unicodedata.normalize("NFD", ch)
    )


@lru_cache(maxsize=None)
def marked_letter_class() -> str:
    return _class_of(carries_mark)


@lru_cache(maxsize=None)
def other_digit_class() -> str:
    """Digits that are not decimal, such as superscripts."""
    return _class_of(lambda c: c.isdigit() and unicodedata.category(c) != "Nd")


@lru_cache(maxsize=None)
def _strip_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What loses a combining mark or a stroke: letters and their bases for ``translate``, with
    the marks themselves last, as they have no base; and letters whose base is more than one."""
    source, target, gone, many = [], [], [], []
    for cp in range(LAST + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kept = "".join(p for p in unicodedata.normalize("NFD", ch) if not unicodedata.combining(p))
        base = unicodedata.normalize("NFC", kept.replace("đ", "d").replace("Đ", "D"))
        if base == ch:
            continue
        if not base:
            gone.append(ch)
        elif len(base) == 1:
            source.append(ch)
            target.append(base)
        else:
            many.append((ch, base))
    return "".join([*source, *gone]), "".join(target), tuple(many)


@lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What full case folding changes beyond lower-casing: one-to-one and one-to-many."""
    source, target, many = [], [], []
    for cp in range(LAST + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = ch.casefold()
        if ch.lower() != ch or folded == ch:
            continue
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            many.append((ch, folded))
    return "".join(source), "".join(target), tuple(many)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_spaces(x: Column) -> Column:
    """Every run of white space becomes one space; none is left at either end."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def strip_spaces(x: Column) -> Column:
    """White space removed at both ends only."""
    return F.regexp_replace(x, f"{SPACE}+\\z|\\A{SPACE}+", "")


def normalise_answer(x: Column) -> Column:
    """The form in which answers are compared. Diacritics are kept."""
    return F.lower(collapse_spaces(x))


def casefold(x: Column) -> Column:
    """Full Unicode case folding."""
    source, target, many = _fold_tables()
    rare = [(a, b) for a, b in many if a != "ß"]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rare])
    folded = F.replace(F.translate(F.lower(x), source, target), F.lit("ß"), F.lit("ss"))
    # Few texts hold one of the other long-folding letters; only those take the longer way.
    return once(
        folded,
        lambda s: F.when(
            F.translate(s, "".join(a for a, _ in rare), "") != s,
            F.aggregate(pairs, s, lambda acc, p: F.replace(acc, p["a"], p["b"])),
        ).otherwise(s),
    )


def dedup_key(x: Column) -> Column:
    """Key under which two strings count as the same."""
    return casefold(collapse_spaces(x))


def strip_marks(x: Column) -> Column:
    """Every character with a combining class and the stroke of the d removed. Idempotent."""
    source, target, many = _strip_table()
    stripped = F.translate(x, source, target)
    if not many:
        return stripped
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in many])
    return once(
        stripped,
        lambda s: F.when(
            F.translate(s, "".join(a for a, _ in many), "") != s,
            F.aggregate(pairs, s, lambda acc, p: F.replace(acc, p["a"], p["b"])),
        ).otherwise(s),
    )


def sentences(x: Column, min_chars: int = SENTENCE_MIN, max_chars: int = SENTENCE_MAX) -> Column:
    """Array of stripped pieces between runs of . ! ? and line ends, within the length bounds."""
    pieces = F.transform(F.split(x, r"[.!?\n]+"), strip_spaces)
    return F.filter(pieces, lambda s: F.char_length(s).between(min_chars, max_chars))


def looks_like_prose(x: Column) -> Column:
    stripped = strip_spaces(x)
    return (
        F.contains(stripped, F.lit(" "))
        & (F.char_length(stripped) >= PROSE_MIN)
        & ~F.contains(stripped, F.lit("://"))
    )


def is_blank(x: Column) -> Column:
    return ~x.rlike(NOT_SPACE)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0 where ``den`` is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _count(x: Column, body: str) -> Column:
    return F.char_length(F.regexp_replace(x, f"[^{body}]+", "")).cast("long")


def letter_count(x: Column) -> Column:
    return _count(x, r"\p{L}")


def word_count(x: Column) -> Column:
    return F.char_length(
        F.regexp_replace(F.regexp_replace(x, NOT_SPACE + "+", "a"), SPACE + "+", "")
    ).cast("long")


def _beyond_ascii(x: Column) -> Column:
    """What is left for the long classes, which hold no ASCII character."""
    return F.regexp_replace(x, r"[\x00-\x7f]+", "")


def diacritic_ratio(x: Column) -> Column:
    return ratio(_count(_beyond_ascii(x), marked_letter_class()), letter_count(x))


def digit_ratio(x: Column) -> Column:
    other = _count(_beyond_ascii(x), other_digit_class())
    return ratio(_count(x, r"\p{Nd}") + other, F.char_length(x))


def upper_ratio(x: Column) -> Column:
    return ratio(_count(x, r"\p{IsUppercase}"), letter_count(x))


def space_ratio(x: Column) -> Column:
    spaces = F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    return ratio(spaces, F.char_length(x))


def single_char_token_ratio(x: Column) -> Column:
    longer_gone = F.regexp_replace(x, NOT_SPACE + "{2,}", "")
    singles = F.char_length(F.regexp_replace(longer_gone, SPACE + "+", ""))
    return ratio(singles, word_count(x))


def elide(x: Column, width: int = 60) -> Column:
    """Cut to ``width`` code points, the last one an ellipsis when something was cut."""
    return F.when(
        F.char_length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))
    ).otherwise(x)
