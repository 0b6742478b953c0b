"""Noise modes: what speech and character recognition do to accented text.

A whole Arrow batch is one flat array of code points. Each mode is a few array operations
on it; coins are position-indexed (see ``hashing``), so nothing is drawn in sequence.
Texts are always processed whole.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanefold.functions.hashing import beta_2_5, key_hash, uniforms
from lanefold.functions.text import strip_marks

# Noise modes in cycling order.
MODES = (
    "drop_all",
    "random_drop",
    "tone_swap",
    "mixed",
    "space_split",
    "char_confuse",
    "mixed_ocr",
    "word_merge",
    "homophone_swap",
    "case_noise",
)

# Tone marks grave, acute, tilde, hook above, dot below.
TONES = (0x0300, 0x0301, 0x0303, 0x0309, 0x0323)

# Look-alike characters and what each may be read as.
LOOK_ALIKES = {
    "0": "Oo", "1": "lI", "2": "Zz", "3": "E", "4": "Ah", "5": "Ss", "6": "Gb", "7": "T",
    "8": "B", "9": "gq", "A": "4", "B": "8", "E": "3", "G": "6", "I": "1l", "O": "0",
    "S": "5", "T": "7", "Z": "2", "b": "6", "c": "e", "e": "c", "g": "9q", "h": "n",
    "l": "1I", "n": "h", "o": "0", "q": "9g", "s": "5", "z": "2",
}

# Letter pairs that read as one letter.
PAIR_ALIKES = {"rn": "m", "cl": "d"}

CHUNK_CHARS = 1 << 17
PIECE_BYTES = 1 << 20

VOWELS = "aeiouyAEIOUY"
STROKE_D = {"đ": "d", "Đ": "D"}


@lru_cache(maxsize=None)
def _is_mark() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for cp in range(0x110000):
        if unicodedata.combining(chr(cp)):
            table[cp] = True
    return table


@lru_cache(maxsize=None)
def _look_alike_table() -> tuple[np.ndarray, np.ndarray]:
    """Number of readings, and the readings, by code point below 128."""
    n = np.zeros(128, dtype=np.int64)
    options = np.zeros((128, 2), dtype=np.uint32)
    for source, readings in LOOK_ALIKES.items():
        n[ord(source)] = len(readings)
        for j, reading in enumerate(readings):
            options[ord(source), j] = ord(reading)
    return n, options


@dataclass
class Flat:
    """Code points of all texts of a batch, one after the other."""

    code: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Flat:
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        return cls(
            np.frombuffer(raw, dtype=np.uint32).copy(),
            np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)),
        )

    @cached_property
    def start(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.length)), self.length)

    def texts(self) -> list[str]:
        whole = self.code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(self.length)
        return [whole[e - n : e] for e, n in zip(ends.tolist(), self.length.tolist())]

    def rebuilt(
        self,
        keep: np.ndarray | None = None,
        before: np.ndarray | None = None,
        after: np.ndarray | None = None,
    ) -> Flat:
        """Some characters left out, and at most one put before and after each (0: none)."""
        n = len(self.code)
        parts = [x for x in (before, self.code, after) if x is not None]
        alive = [(np.ones(n, dtype=bool) if keep is None else keep) if x is self.code else x != 0 for x in parts]
        size = alive[0].astype(np.int8)
        for more in alive[1:]:
            size += more
        through = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        length = through[self.start + self.length] - through[self.start]
        if len(parts) == 1:
            return Flat(self.code[alive[0]], length)
        code, at = np.empty(through[-1], dtype=np.uint32), through[:-1].copy()
        for part, some in zip(parts, alive):
            code[at[some]] = part[some]
            at += some
        return Flat(code, length)


def _coins(flat: Flat, h: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """A uniform number for each character index in ``at``."""
    owner = flat.owner[at]
    return uniforms(h[owner], stream, at - flat.start[owner])


def _struck(flat: Flat, eligible: np.ndarray, p: np.ndarray, h: np.ndarray, stream: int) -> np.ndarray:
    """Indices of the eligible characters whose coin falls below the severity of their text."""
    at = np.flatnonzero(eligible)
    return at[_coins(flat, h, stream, at) < p[flat.owner[at]]]


def _decomposed(texts: list[str]) -> Flat:
    return Flat.of([unicodedata.normalize("NFD", t) for t in texts])


def _composed(flat: Flat) -> list[str]:
    return [unicodedata.normalize("NFC", t) for t in flat.texts()]


def _without_strokes(flat: Flat, at: np.ndarray | slice) -> None:
    code = flat.code[at]
    for stroked, plain in STROKE_D.items():
        code[code == ord(stroked)] = ord(plain)
    flat.code[at] = code


def drop_all(texts: list[str]) -> list[str]:
    flat = _decomposed(texts)
    _without_strokes(flat, slice(None))
    return _composed(flat.rebuilt(keep=~_is_mark()[flat.code]))


def random_drop(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = _decomposed(texts)
    mark = _is_mark()[flat.code]
    stroke = (flat.code == ord("đ")) | (flat.code == ord("Đ"))
    hit = _struck(flat, mark | stroke, p, h, stream)
    keep = np.ones(len(flat.code), dtype=bool)
    keep[hit[mark[hit]]] = False
    _without_strokes(flat, hit)
    return _composed(flat.rebuilt(keep=keep))


def _tone_number(code: np.ndarray) -> np.ndarray:
    """1-based place among the tones; 0 for anything else."""
    tones = np.array(TONES, dtype=np.uint32)
    place = np.minimum(np.searchsorted(tones, code), len(tones) - 1)
    return np.where(tones[place] == code, place + 1, 0)


def tone_swap(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = _decomposed(texts)
    hit = _struck(flat, _tone_number(flat.code) > 0, p, h, stream)
    current = _tone_number(flat.code[hit])
    pick = np.floor(_coins(flat, h, stream + 1, hit) * (len(TONES) - 1)).astype(np.int64) + 1
    chosen = np.where(pick < current, pick, pick + 1)
    flat.code[hit] = np.array(TONES, dtype=np.uint32)[chosen - 1]
    return _composed(flat)


def space_split(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = Flat.of(texts)
    space = flat.code == ord(" ")
    owner, start = flat.owner, flat.start
    head = np.zeros(len(flat.code), dtype=bool)
    head[start[flat.length > 0]] = True
    head[1:] |= space[:-1]
    first = np.flatnonzero(head & ~space)  # where each word begins
    spaces_before = np.cumsum(space) - space
    number = spaces_before[first] - spaces_before[start[owner[first]]]
    word = np.cumsum(head & ~space) - 1
    size = np.bincount(word[~space], minlength=len(first))
    hit = (uniforms(h[owner[first]], stream, number) < p[owner[first]]) & (size >= 2)
    inside = ~space & ~head
    inside[inside] = hit[word[inside]]
    before = np.where(inside, ord(" "), 0)
    return flat.rebuilt(before=before).texts()


def char_confuse(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = Flat.of(texts)
    owner, original = flat.owner, flat.code.copy()
    keep = np.ones(len(original), dtype=bool)
    free = np.ones(len(original), dtype=bool)
    for (left, right), merged in ((tuple(pair), one) for pair, one in PAIR_ALIKES.items()):
        pair_at = np.zeros(len(original), dtype=bool)
        pair_at[:-1] = (
            (original[:-1] == ord(left)) & (original[1:] == ord(right)) & (owner[:-1] == owner[1:])
        )
        at = _struck(flat, pair_at, p, h, stream)
        flat.code[at] = ord(merged)
        keep[at + 1] = False
        free[at] = free[at + 1] = False
    n, options = _look_alike_table()
    ascii_code = np.where(original < 128, original, 0)
    hit = _struck(flat, (n[ascii_code] > 0) & free, p, h, stream + 1)
    source = original[hit]
    pick = np.floor(_coins(flat, h, stream + 2, hit) * n[source]).astype(np.int64)
    flat.code[hit] = options[source, pick]
    return flat.rebuilt(keep=keep).texts()


def word_merge(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = Flat.of(texts)
    keep = np.ones(len(flat.code), dtype=bool)
    keep[_struck(flat, flat.code == ord(" "), p, h, stream)] = False
    return flat.rebuilt(keep=keep).texts()


def case_noise(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    out = []
    for text, rate, key in zip(texts, p.tolist(), h.tolist()):
        words = text.split(" ")
        at = np.arange(len(words))
        keys = np.full(len(words), key)
        hit = np.flatnonzero(uniforms(keys, stream, at) < rate)
        pick = uniforms(keys[hit], stream + 1, hit)
        for j, u in zip(hit.tolist(), pick.tolist()):
            word = words[j]
            forms = [f for f in (word.lower(), word.upper(), word.title()) if f != word]
            if forms:
                words[j] = forms[int(u * len(forms))]
        out.append(" ".join(words))
    return out


def homophone_swap(texts: list[str], p: np.ndarray, h: np.ndarray, stream: int) -> list[str]:
    flat = _decomposed(texts)
    n = len(flat.code)
    vowel = np.isin(flat.code, np.array([ord(v) for v in VOWELS], dtype=np.uint32))
    hit = _struck(flat, vowel, p, h, stream)
    follows = np.zeros(n + 1, dtype=bool)  # is this a mark on the character before it?
    follows[1:n] = _is_mark()[flat.code[1:]] & (flat.owner[1:] == flat.owner[:-1])
    keep = np.ones(n, dtype=bool)
    current = np.zeros(len(hit), dtype=np.int64)
    end = hit.copy()
    walking = np.arange(len(hit))
    while len(walking):  # one round per mark of the longest run
        walking = walking[follows[end[walking] + 1]]
        end[walking] += 1
        tone = _tone_number(flat.code[end[walking]])
        removed = (tone > 0) & (current[walking] == 0)
        keep[end[walking[removed]]] = False
        current[walking[removed]] = tone[removed]
    pick = np.floor(_coins(flat, h, stream + 1, hit) * len(TONES)).astype(np.int64)
    chosen = np.where(pick < current, pick, pick + 1)
    after = np.zeros(n, dtype=np.uint32)
    after[end] = np.array((0, *TONES), dtype=np.uint32)[chosen]
    return _composed(flat.rebuilt(keep=keep, after=after))


def apply_mode(texts: list[str], mode: str, h: np.ndarray) -> list[str]:
    """One mode over a batch; ``h`` holds one key hash per text. Severities follow Beta(2, 5)."""
    if mode == "drop_all":
        return drop_all(texts)
    if mode == "mixed":
        return tone_swap(random_drop(texts, beta_2_5(h, 1), h, 2), beta_2_5(h, 3), h, 4)
    if mode == "mixed_ocr":
        out = random_drop(texts, beta_2_5(h, 1), h, 2)
        out = char_confuse(out, beta_2_5(h, 3), h, 4)
        return space_split(out, beta_2_5(h, 7), h, 8)
    single = {
        "random_drop": random_drop,
        "tone_swap": tone_swap,
        "space_split": space_split,
        "char_confuse": char_confuse,
        "word_merge": word_merge,
        "homophone_swap": homophone_swap,
        "case_noise": case_noise,
    }
    if mode not in single:
        raise ValueError(f"unknown noise mode: {mode!r}")
    return single[mode](texts, beta_2_5(h, 1), h, 2)


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown noise mode: {mode!r}; known: {', '.join(MODES)}")
    return mode


def _noised(texts: list[str | None], mode: str, keys: list[str]) -> list[str | None]:
    """Whole texts, taken in chunks of a bounded number of characters; NULL stays NULL."""
    out: list[str | None] = [None] * len(texts)
    rows: list[int] = []
    chunk: list[str] = []
    size = 0

    def flush() -> None:
        h = np.array([key_hash(keys[r]) for r in rows], dtype=np.int64)
        for r, noisy in zip(rows, apply_mode(chunk, mode, h)):
            out[r] = noisy
        rows.clear()
        chunk.clear()

    for r, text in enumerate(texts):
        if text is None:
            continue
        rows.append(r)
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            flush()
            size = 0
    if rows:
        flush()
    return out


def noise(text: Column, mode: str, seed: int = 0, salt: Column | None = None) -> Column:
    """Noised text, keyed by seed, mode and the text itself, or by seed, mode and ``salt``."""
    _checked(mode)
    if mode == "drop_all":
        return strip_marks(text)

    def noised(texts: pa.Array, keys: pa.Array) -> pa.Array:
        salted = [f"{seed}|{mode}|{k}" for k in keys.to_pylist()]
        return pa.array(_noised(texts.to_pylist(), mode, salted), pa.string())

    if salt is not None:
        return F.arrow_udf(T.StringType())(lambda texts, keys: _by_pieces(noised, texts, keys))(text, salt)
    return F.arrow_udf(T.StringType())(lambda texts: _by_pieces(lambda t: noised(t, t), texts))(text)


def _by_pieces(work: Callable[..., pa.Array], texts: pa.Array, *rest: pa.Array) -> pa.Array:
    """``work`` on stretches of a batch of about ``PIECE_BYTES``, one row at least, so that Python holds few texts at a time.

    What the allocators keep is handed back: workers live on, and the sum of their peaks would stay.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size, dtype=np.int64) // PIECE_BYTES
    starts = [*np.flatnonzero(np.diff(cut, prepend=-1)).tolist(), len(texts)] if len(texts) else [0, 0]
    out = pa.concat_arrays([work(*[x.slice(a, b - a) for x in (texts, *rest)]) for a, b in zip(starts, starts[1:])])
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return out


def cycle(k: int | None = None) -> list[str]:
    """The modes of ``k`` variants: all modes by default, over again beyond their number."""
    k = len(MODES) if k is None else k
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    return [MODES[i % len(MODES)] for i in range(k)]


def variants(text: Column, k: int | None = None, seed: int = 0) -> Column:
    """Array of (variant, mode, noisy) structs, for ``inline``. The text crosses to Python once."""
    modes = cycle(k)
    schema = T.ArrayType(
        T.StructType(
            [
                T.StructField("variant", T.IntegerType()),
                T.StructField("mode", T.StringType()),
                T.StructField("noisy", T.StringType()),
            ]
        )
    )

    def noised(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        noisy = []
        for i, mode in enumerate(modes):
            again = i // len(MODES)
            prefix = f"{seed}|{mode}|" if again == 0 else f"{seed}|{mode}#{again}|"
            noisy.append(_noised(texts, mode, [f"{prefix}{t}" for t in texts]))
        n, k = len(texts), len(modes)
        flat = pa.StructArray.from_arrays(
            [
                pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
                pa.array(modes * n, pa.string()),
                pa.array([variant for row in zip(*noisy) for variant in row], pa.string()),
            ],
            names=["variant", "mode", "noisy"],
        )
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)

    return F.arrow_udf(schema)(lambda texts: _by_pieces(noised, texts))(text)
