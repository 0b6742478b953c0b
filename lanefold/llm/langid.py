"""Language identification by prediction by partial matching over bytes.

For each language a context tree of bytes, ``ORDER`` deep, is counted on a bounded sample of
labelled documents (``MAX_DOCS`` of each language, chosen by a hash of their id, whole texts).
The counts are frozen. A byte is predicted from the deepest context the tree holds; what was
never seen there escapes to the next shorter one with the probability u / (n + u), u kinds
among n bytes, and the shorter context's distribution leaves out what the longer one
holds. The distributions sum to one exactly, so minus their logarithms are code lengths, and
the language that codes the whole text in the fewest bits is predicted.

Frozen trees make the code length of a byte a function of the bytes before it. Each task
unfolds the trees into one table (context, byte) -> bits per language and scores whole batches by
look-ups. Its size follows the sample and the number of languages, not the corpus.

Null texts, and texts without a letter, are ``und`` with score 0, as is everything if there is
nothing to learn from. Equal code lengths go to the first language in order. The score is
the posterior of the predicted language with evidence counted as that of ``FULL_BYTES`` bytes at
most, so that long texts don't all score 1. Repeated rows are scored alike; other columns are
kept out; ``lang`` is read for learning only, and only where ``learn`` allows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import forgetting, held_out, own_columns, per_row, releasing, resident, sample_of_each, shielded, slices, text_column

ORDER = 3
MAX_DOCS = 1500
FULL_BYTES = 200
SLICE_BYTES = 1 << 20
STRETCH = 1 << 17
CONTEXTS = 4096


class Counts(NamedTuple):
    """How often each byte followed each context of ``ORDER`` bytes, by language."""

    key: str
    languages: list[str]
    language: np.ndarray
    gram: np.ndarray  # the context and the byte, as ORDER + 1 bytes; 0 before a text's start
    n: np.ndarray


class Tables:
    """The unfolded trees: bits of a byte after a context, for all languages at once."""

    def __init__(self, counts: Counts):
        grams = np.stack([(counts.gram >> (8 * i)) & 255 for i in range(ORDER, -1, -1)], axis=1)
        used = np.unique(grams)
        used = used[used != 0]
        # Bytes of the sample get numbers of their own; all others share 0 with the start.
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.s = s = len(used) + 1
        grams = self.symbol[grams]
        contexts = (grams[:, :-1] * s ** np.arange(ORDER - 1, -1, -1)).sum(axis=1)
        deep, where = np.unique(contexts, return_inverse=True)
        shallow = s ** (ORDER - 1)
        self.row = np.arange(s**ORDER, dtype=np.int32) % shallow + len(deep)
        self.row[deep] = np.arange(len(deep))
        bits = np.empty((len(deep) + shallow, s, len(counts.languages)), dtype=np.float32)
        for j in range(len(counts.languages)):
            mine = counts.language == j
            g, n = grams[mine], counts.n[mine].astype(np.float64)
            p = np.full((1, s), 1 / s)
            for order in range(ORDER):
                seen = np.zeros((s**order, s))
                code = (g[:, ORDER - order : ORDER] * s ** np.arange(order - 1, -1, -1)).sum(axis=1) if order else 0
                np.add.at(seen, (code, g[:, -1]), n)
                p = blend(seen, p[np.arange(s**order) % len(p)])
            bits[len(deep) :, :, j] = -np.log2(p)
            order = np.argsort(where[mine], kind="stable")
            row, byte, n = where[mine][order], g[order, -1], n[order]
            for a in range(0, len(deep), CONTEXTS):
                of = deep[a : a + CONTEXTS]
                k, e = np.searchsorted(row, (a, a + len(of)))
                seen = np.zeros((len(of), s))
                np.add.at(seen, (row[k:e] - a, byte[k:e]), n[k:e])
                bits[a : a + len(of), :, j] = -np.log2(blend(seen, p[of % shallow]))
        self.bits = bits.reshape(-1, bits.shape[-1])

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; texts lie in ``data`` between ``offsets``.

        Of texts of any length a stretch at a time is held in numbers.
        """
        out = np.zeros((len(offsets) - 1, self.bits.shape[-1]))
        for a in range(0, len(data), STRETCH):
            b, low = min(a + STRETCH, len(data)), max(0, a - ORDER)
            first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
            sym = self.symbol[data[low:b]]
            context = np.zeros(len(sym), dtype=np.int64)
            for back in range(ORDER, 0, -1):
                before = np.zeros(len(sym), dtype=np.int64)
                before[back:] = sym[:-back]
                for k in range(back):  # nothing is known before a text's start
                    at = offsets[first:last] + k - low
                    before[at[(at >= 0) & (at < len(sym))]] = 0
                context = context * self.s + before
            own = (self.row[context].astype(np.int64) * self.s + sym)[a - low :]
            out[first:last] += per_row(self.bits[own], np.clip(offsets[first : last + 1], a, b) - a)
        return out


def blend(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Distributions after contexts with these counts, given those of the shorter contexts."""
    n = seen.sum(axis=1, keepdims=True)
    new = seen == 0
    kinds = (~new).sum(axis=1, keepdims=True)
    rest = np.where(new, shorter, 0)
    free = rest.sum(axis=1, keepdims=True)
    escape = np.where(free > 0, kinds, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(new, escape / (n + escape) * rest / free, seen / (n + escape))
    return np.where(n > 0, p, shorter)


def fit(docs: DataFrame, learn: Column | None = None, max_docs: int = MAX_DOCS) -> Counts:
    """Counts on at most ``max_docs`` documents of each language, among those ``learn`` allows."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    rows = own_columns(docs.where(learn), doc_id="doc_id", text="text", lang="lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    chosen = sample_of_each(rows.select("doc_id", "lang").distinct(), max_docs, "doc_id", "lang").select(
        F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")
    )
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))

    @forgetting
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t.encode() for t in text_column(part).to_pylist()]
                languages = np.array(part.column("lang").to_pylist(), dtype=object)
                for language in set(languages.tolist()):
                    mine = b"".join(b"\0" * ORDER + t for t, x in zip(texts, languages) if x == language)
                    data = np.frombuffer(mine, np.uint8).astype(np.int64)
                    code = sum(data[i : len(data) - ORDER + i] << (8 * (ORDER - i)) for i in range(ORDER + 1))
                    code, n = np.unique(code[(code & 255) != 0], return_counts=True)
                    yield pa.record_batch(
                        [pa.repeat(language, len(code)), pa.array(code, pa.int64()), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"],
                    )

    counts = (
        sample.dropDuplicates(["doc_id", "lang"])
        .mapInArrow(grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(set(counts["lang"].to_pylist()))
    index = pc.index_in(counts["lang"], pa.array(languages, pa.string()))
    return Counts(
        uuid.uuid4().hex,
        languages,
        index.to_numpy().astype(np.int64),
        counts["gram"].to_numpy(),
        counts["n"].to_numpy(),
    )


def _unfolded(model: Broadcast) -> Tables:
    counts = model.value
    return resident(counts.key, lambda: Tables(counts))


def predict(docs: DataFrame, counts: Counts) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; these two names replace any of the kind."""
    return shielded(docs, ("text",), ("lang_pred", "score"), lambda rows: _predicted(rows, counts))


def _predicted(rows: DataFrame, counts: Counts) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(counts)
    kept = rows.columns

    @releasing
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = text_column(part)
                named = [None] * part.num_rows
                sure = np.zeros(part.num_rows)
                if counts_languages := model.value.languages:
                    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                    offsets = offsets - offsets[0]
                    bits = _unfolded(model).lengths(data, offsets)
                    best = bits.argmin(axis=1)
                    weight = np.minimum(1, FULL_BYTES / np.maximum(1, np.diff(offsets)))[:, None]
                    sure = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * weight).sum(axis=1)
                    letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
                    named = [counts_languages[b] if ok else None for b, ok in zip(best.tolist(), letters)]
                sure = np.where([x is None for x in named], 0.0, sure)
                named = pa.array([x or "und" for x in named], pa.string())
                yield pa.record_batch([*part.columns, named, pa.array(sure, pa.float64())], [*kept, "lang_pred", "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learnt from those not held out."""
    counts = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, counts).select("doc_id", "held_out", "lang_pred", "score")
