"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine.

Labelled documents (``MAX_EXAMPLES`` at most, chosen by a hash of their id) serve as examples. The
vocabulary is every lower-cased word of theirs, told apart by 64-bit hashes. A word weighs
(1 + ln tf) * idf * rf^2: term frequencies are counted over whole texts, document frequencies over
all documents, and the relevance frequency rf = log2(2 + rate among toxic examples / rate among
others) lets words count for more that toxic examples have more often; squared, so that one of them
shows in a long text. No word weighs nothing.

Search uses an inverted index of the examples in blocks of ``BLOCK``: a word's postings are grouped
by block, and each group bears its largest weight. The postings of the ``COMMON`` commonest words are
written out as rows, which many texts meet in one product; of the others a text reads the groups of its own words
only. A block's largest sum over common words and the weights of its groups bound the cosine of any
example in it, so the blocks of the highest bounds are visited first, and of the others only those whose bound reaches the k-th best
cosine found: the neighbours are exact. Ties go to the smaller example id. Votes are weighted by cosine. Scores are then calibrated on
the examples, each scored without itself, by monotone regression; examples weigh as their class
occurs among the labels.

A text without any word of the examples, as a null or empty one, is at distance one from everything
and takes the rate of toxic labels. Labels with null values or of unknown documents teach
nothing; contradicting labels of one document count as toxic, and of several texts under one id the
least one is learnt. With no toxic examples every score is 0. The evidence of a score is its
neighbours' ids and cosines. Repeated rows are scored alike; other columns pass through ``score``
unless they bear a result's name.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import held_out, keeping, own_columns, ranges, released, releasing, resident, sample_of_each, shielded, slices, stored, text_column

MAX_EXAMPLES = 8_000
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 8
COMMON = 256
TEXTS_AT_ONCE = 64
ROWS_AT_ONCE = 1024
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20
PIECE_CHARS = 1 << 20
MOST_KEPT = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, by stretches of bounded length that end between words."""
    text, at = text.lower(), 0
    while at < len(text):
        stop = _NO_LETTER.search(text, at + PIECE_CHARS)
        end = stop.start() if stop else len(text)
        yield _WORD.findall(text, at, end)
        at = end


class _Hashes(dict):
    """Hashes of the words a worker met."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return found


_hashes = keeping(_Hashes())


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, count) by texts: how often each text has each of its words."""
    names, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for text in texts:
        seen: Counter[str] = Counter()
        for some in words_of(text):
            seen.update(some)
        if len(_hashes) > MOST_KEPT:
            _hashes.clear()
        names.append(np.fromiter(map(_hashes.__getitem__, seen), np.uint64, len(seen)))
        counts.append(np.fromiter(seen.values(), np.int64, len(seen)))
    row = np.repeat(np.arange(len(texts)), [len(n) for n in names[1:]])
    return row, np.concatenate(names), np.concatenate(counts)


class Examples(NamedTuple):
    """What the index is made from, small enough to be sent to every worker."""

    key: str
    words: np.ndarray  # hashes in order
    df: np.ndarray
    total: int
    ids: np.ndarray
    toxic: np.ndarray
    sizes: np.ndarray  # words of each example
    word: np.ndarray  # of the examples in turn, in the smallest type that holds them
    tf: np.ndarray
    blank_rate: float


class Index(NamedTuple):
    """Postings of the examples by word and block, and what bounds each group of them."""

    words: np.ndarray  # hashes in order
    weight: np.ndarray  # idf * rf of each word
    ids: np.ndarray
    toxic: np.ndarray
    groups: np.ndarray  # of each word, where its groups start; one more at the end
    block: np.ndarray  # of each group
    most: np.ndarray  # the largest weight in each group
    postings: np.ndarray  # of each group, where its postings start; one more at the end
    example: np.ndarray  # of each posting
    value: np.ndarray
    common: np.ndarray  # the words of most postings, in order
    rows: np.ndarray  # their postings written out, a row for each over all examples
    blank_rate: float
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # raw scores and what they are worth
    made: Broadcast | None = None  # the examples, on the driver's side


def examples(docs: DataFrame, labels: DataFrame, learn: Column, max_examples: int = MAX_EXAMPLES) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) of the labelled documents to learn from, and the share of toxic ones among all."""
    known = own_columns(docs, doc_id="doc_id").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_known"))
    marked = stored(
        own_columns(labels, doc_id="doc_id", toxic="toxic")
        .where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .join(known, F.col("doc_id") == F.col("_known"), "left_semi"),
        "marked",
    )
    share = marked.agg(F.avg("toxic")).first()[0] or 0.0
    # Toxic documents are the rarer ones: half of the examples, if there are as many.
    chosen = sample_of_each(marked, max_examples // 2, "doc_id", "toxic").select(F.col("doc_id").alias("_id"), "toxic")
    texts = own_columns(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), share


def termed(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, words, counts) of examples: the hashes of their words, and how often each."""
    kind = sample.schema["doc_id"].dataType.simpleString()

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                row, name, tf = hashes_of(text_column(part).to_pylist())
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (name.view(np.int64), tf.astype(np.int64))]
                yield pa.record_batch([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "words", "counts"])

    return sample.select("doc_id", "toxic", "text").mapInArrow(count, f"doc_id {kind}, toxic int, words array<bigint>, counts array<bigint>")


def _knowing(model: Broadcast):
    """A function of (doc_id, text) to (doc_id, words, counts): places in the vocabulary, and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                row, name, tf = hashes_of(text_column(part).to_pylist())
                at = places(model.value, name)
                known = at < len(model.value)
                ends = pa.array(np.searchsorted(row[known], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[known].astype(np.int32))) for x in (at, tf)]
                yield pa.record_batch([part.column("doc_id"), *lists], ["doc_id", "words", "counts"])

    return count


def known_terms(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, words, counts) of every document: places in the vocabulary, and how often each occurs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = releasing(_knowing(docs.sparkSession.sparkContext.broadcast(words)))
    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(count, f"doc_id {kind}, words array<int>, counts array<int>")


def tallies(docs: DataFrame, words: np.ndarray, terms: DataFrame | None = None) -> DataFrame:
    """(word, n): in how many documents of a task each place in the vocabulary occurs; at -1, how many documents there are.

    From the ``terms`` of all documents, if they are written out. Else one function counts words and tallies them: two
    in a row would take two workers a task, which live on beside all later steps.
    """
    size = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            known += np.bincount(batch.column("words").flatten().to_numpy(), minlength=size)
            total += batch.num_rows
        some = np.flatnonzero(known)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(known[some], total))], ["word", "n"])

    if terms is not None:
        return terms.select("words").mapInArrow(count, "word bigint, n bigint")
    known_in = _knowing(docs.sparkSession.sparkContext.broadcast(words))
    both = releasing(lambda batches: count(known_in(batches)))
    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(both, "word bigint, n bigint")


def document_frequencies(docs: DataFrame, words: np.ndarray, terms: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """In how many documents each of the words occurs, and how many documents there are."""
    # A row per word of the examples and one for the number of documents.
    rows = tallies(docs, words, terms).groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(len(words), dtype=np.int64)
    out[word[word >= 0]] = n[word >= 0]
    return out, int(n[word < 0].sum())


def places(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where each hash is in the vocabulary; unknown ones come after its end."""
    at = np.searchsorted(words, names)
    known = at < len(words)
    known[known] = words[at[known]] == names[known]
    return np.where(known, at, len(words))


def weighted(index: Index, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, weights) of one text at unit length, over the words it shares with the examples."""
    at = places(index.words, names)
    known = at < len(index.words)
    return weighted_at(index, at[known], counts[known])


def weighted_at(index: Index, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``weighted`` from places in the vocabulary."""
    values = (1 + np.log(tf)) * index.weight[at]
    norm = np.sqrt((values**2).sum())
    return at, values / norm if len(at) else values


def shared(index: Index, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the commonest words add to the cosine of each text (words, weights) with each example."""
    factors = np.zeros((len(texts), len(index.common)))
    for i, (words, values) in enumerate(texts):
        at = places(index.common, words)
        known = at < len(index.common)
        factors[i, at[known]] = values[known]
    return factors @ index.rows


def nearest(
    index: Index, words: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None, base: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k examples nearest to a text, ties by id, zeros left out.

    ``base`` is the text's row of ``shared``.
    """
    if base is None:
        base = shared(index, [(words, values)])[0]
    rare = places(index.common, words) == len(index.common)
    words, values = words[rare], values[rare]
    first, last = index.groups[words], index.groups[words + 1]
    group, factor = ranges(first, last), np.repeat(values, last - first)
    block = index.block[group]
    starts = np.arange(0, len(base), BLOCK)
    bound = np.maximum.reduceat(base, starts) + np.bincount(block, factor * index.most[group], minlength=len(starts))
    order = np.argsort(-bound, kind="stable")
    rows, cosines, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    # The best blocks first; what they give settles which of the others can still matter.
    for some in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
        some = some[(bound[some] > 0) & (bound[some] + 1e-9 >= least)]
        if not len(some):
            break
        visited = np.zeros(len(bound), dtype=bool)
        visited[some] = True
        if 2 * len(some) > len(bound):  # nearly all of them: postings by words are longer stretches
            start, end, by = index.postings[first], index.postings[last], values
        else:
            here = visited[block]
            start, end, by = index.postings[group[here]], index.postings[group[here] + 1], factor[here]
        at = ranges(start, end)
        found = np.bincount(index.example[at], np.repeat(by, end - start) * index.value[at], minlength=len(index.ids))
        found = (found + base) * np.repeat(visited, BLOCK)[: len(found)]
        if skip is not None:
            found[skip] = 0
        if not least and len(found) > 4 * k:
            least = max(0.0, float(np.partition(found, -k)[-k]) - 1e-9)
        at = np.flatnonzero((found > 0) & (found >= least - 1e-9))
        found = np.round(found[at], 12)
        rows, cosines = np.append(rows, at), np.append(cosines, found)
        best = np.lexsort((index.ids[rows], -cosines))[:k]
        rows, cosines = rows[best], cosines[best]
        if len(rows) == k:
            least = cosines[-1]
    return rows, cosines


def all_nearest(
    index: Index, texts: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``nearest`` of each text, some at a time."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts[at : at + TEXTS_AT_ONCE]
        for i, (text, base) in enumerate(zip(some, shared(index, some)), at):
            yield nearest(index, *text, skip=skip[i] if skip else None, base=base)


def vote(index: Index, rows: np.ndarray, cosines: np.ndarray) -> float:
    """The share of toxic neighbours, weighted by closeness; missing votes are those of a blank text."""
    if not len(rows):
        return index.blank_rate
    prior = 0.5 * index.blank_rate
    return float(((cosines * index.toxic[rows]).sum() + prior) / (cosines.sum() + 0.5))


def monotone(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Increasing step values of y over x, by pooling neighbours that decrease."""
    weights = np.ones(len(x)) if weights is None else weights
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weights[order].tolist()):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, n2 = blocks.pop()
            a1, b1, n1 = blocks[-1]
            blocks[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def inverted(of: Examples) -> Index:
    """The index of some examples."""
    words, df, ids, toxic, word, tf = of.words, of.df, of.ids, of.toxic, of.word.astype(np.int64), of.tf.astype(np.float64)
    row = np.repeat(np.arange(len(ids)), of.sizes)
    p, n = (np.bincount(word[toxic[row] == t], minlength=len(words)) for t in (1, 0))
    toxics, others = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    rf = np.log2(2 + (p / toxics) / (np.maximum(n, 1) / others))
    weight = (np.log((1 + of.total) / (1 + df)) + 1) * rf**2
    value = (1 + np.log(tf)) * weight[word]
    value /= np.sqrt(np.bincount(row, value**2, minlength=len(ids)))[row]
    # Examples of one kind share blocks, which tightens the bounds: by their commonest word, then their heaviest.
    heaviest, commonest = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    for key, best in ((value, heaviest), (df[word], commonest)):
        order = np.lexsort((key, row))
        best[row[order]] = word[order]  # the last of each row stays
    order = np.lexsort((ids, heaviest, commonest))
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.arange(len(ids))
    row = at[row]
    by = np.lexsort((row, word))
    row, word, value = row[by].astype(np.int32), word[by], value[by]
    block = row // BLOCK
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1]))[: len(row)])
    ends = np.searchsorted(word, np.arange(len(words) + 1))
    common = np.sort(np.argsort(-np.diff(ends), kind="stable")[:COMMON])
    written = np.zeros((len(common), len(ids)))
    for one, w in zip(written, common):
        one[row[ends[w] : ends[w + 1]]] = value[ends[w] : ends[w + 1]]
    return Index(
        words, weight, ids[order], toxic[order],
        np.searchsorted(word[new], np.arange(len(words) + 1)), block[new],
        np.maximum.reduceat(value, new) if len(new) else value, np.append(new, len(row)), row, value,
        common, written, of.blank_rate,
    )


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Index:
    """The index of the examples, with document frequencies over all of ``docs``."""
    return fitted(docs, labels, learn)[0]


def fitted(docs: DataFrame, labels: DataFrame, learn: Column | None = None, keep: bool = False) -> tuple[Index, DataFrame | None]:
    """``fit``, and the ``known_terms`` of all documents written out, if they are to be read again."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    sample, share = examples(docs, labels, learn)
    sample = stored(termed(stored(sample, "examples")), "terms")
    rows = sample.toArrow().sort_by("doc_id")  # at most MAX_EXAMPLES
    lists = rows["words"].combine_chunks()
    some = lists.value_lengths().to_numpy()
    names = lists.flatten().to_numpy().view(np.uint64)
    tf = rows["counts"].combine_chunks().flatten().to_numpy()
    words = np.unique(names)
    terms = stored(known_terms(docs, words), "documents") if keep else None
    df, total = document_frequencies(docs, words, terms)
    has = some > 0
    ids, toxic = rows["doc_id"].to_numpy()[has], rows["toxic"].to_numpy().astype(np.float64)[has]
    word = np.searchsorted(words, names)
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    # No example without words is in the index, so a blank text has no neighbours.
    made = docs.sparkSession.sparkContext.broadcast(
        Examples(uuid.uuid4().hex, words, small(df), total, ids, toxic, some[has], small(word), small(tf), float(share))
    )
    # The index is built from what was sent; of what that was made from the driver holds nothing meanwhile.
    del rows, lists, names, tf, word, some
    released()
    index = inverted(made.value)._replace(made=made)
    released()
    if not len(ids):
        return index, terms
    raw = _unseen(sample, made)
    # Half of the examples may be toxic; the labels are not.
    odds = share * (1 - toxic.mean()) / ((1 - share) * toxic.mean()) if 0 < toxic.mean() < 1 and share < 1 else 1.0
    return index._replace(steps=monotone(raw, index.toxic, np.where(index.toxic > 0, odds, 1.0))), terms


def _index(made: Broadcast) -> Index:
    """The index in a worker, which keeps it between tasks."""
    return resident(made.value.key, lambda: inverted(made.value))


def _unseen(sample: DataFrame, made: Broadcast) -> np.ndarray:
    """The raw votes of the examples, each scored without itself."""
    @releasing
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(made)
        row_of = {d: i for i, d in enumerate(index.ids.tolist())}
        for batch in batches:
            rows, texts = [], []
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                if d in row_of:
                    names, counts = (batch.column(c)[i].values.to_numpy() for c in ("words", "counts"))
                    rows.append(row_of[d])
                    texts.append(weighted(index, names.view(np.uint64), counts))
            votes = [vote(index, *found) for found in all_nearest(index, texts, rows)]
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(votes, pa.float64())], ["row", "raw"])

    cores = sample.sparkSession.sparkContext.defaultParallelism
    found = sample.repartition(max(2, cores)).mapInArrow(rate, "row bigint, raw double").toArrow().sort_by("row")
    return found["raw"].to_numpy()


def calibrated(index: Index, raw: float) -> float:
    """What a raw vote is worth; raw votes of unseen size take the nearest step."""
    x, y = index.steps
    return float(np.interp(raw, x, y)) if len(x) else raw


def score(docs: DataFrame, index: Index, with_text: bool = False) -> DataFrame:
    """``docs`` with score, predicted and evidence (doc_id, cosine) of the nearest examples; text on demand."""
    added = ["score", "predicted", "evidence"]
    own = ("doc_id", "text")
    return shielded(docs, own, added, lambda rows: _scored(rows, index, added, with_text), () if with_text else ("text",))


def _scored(rows: DataFrame, index: Index, added: list[str], with_text: bool) -> DataFrame:
    made, steps = index.made, index.steps
    kept = [c for c in rows.columns if with_text or c != "text"]
    kind = rows.schema["doc_id"].dataType.simpleString()

    @releasing
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(made)._replace(steps=steps)
        for batch in batches:
            known: dict[bytes, tuple[float, list]] = {}
            for part in slices(batch, "text", SLICE_BYTES):
                texts = text_column(part).to_pylist()
                keys = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
                new = dict.fromkeys(k for k in keys if k not in known)
                first = {k: t for k, t in zip(keys, texts) if k in new}
                row, name, count = hashes_of([first[k] for k in new])
                ends = np.searchsorted(row, np.arange(len(new) + 1))
                terms = [weighted(index, name[a:b], count[a:b]) for a, b in zip(ends, ends[1:])] if len(index.ids) else []
                found = all_nearest(index, terms) if terms else ((np.zeros(0, np.int64), np.zeros(0)) for _ in new)
                known.update(zip(new, (_rated(index, *each) for each in found)))
                s = np.array([known[k][0] for k in keys])
                near = pa.list_(pa.struct([("doc_id", part.schema.field("doc_id").type), ("cosine", pa.float64())]))
                evidence = pa.array([known[k][1] for k in keys], near)
                result = [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32)), evidence]
                yield pa.record_batch([*[part.column(c) for c in kept], *result], [*kept, *added])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(
        rate, f"{fields}score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double>>"
    )


def _rated(index: Index, rows: np.ndarray, cosines: np.ndarray) -> tuple[float, list]:
    if not len(rows):
        return index.blank_rate, []
    near = [{"doc_id": d, "cosine": c} for d, c in zip(index.ids[rows].tolist(), cosines.tolist())]
    return calibrated(index, vote(index, rows, cosines)), near


def scored_terms(terms: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, predicted, evidence) of documents by their ``known_terms``."""
    made, steps = index.made, index.steps
    kind = terms.schema["doc_id"].dataType.simpleString()

    @releasing
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(made)._replace(steps=steps)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            words, counts = (batch.column(c).flatten().to_numpy() for c in ("words", "counts"))
            ends = np.append(0, np.cumsum(batch.column("words").value_lengths().to_numpy()))
            texts = [weighted_at(index, words[a:b], counts[a:b]) for a, b in zip(ends, ends[1:])]
            found = all_nearest(index, texts) if len(index.ids) else ((np.zeros(0, np.int64), np.zeros(0)) for _ in texts)
            scores, near = zip(*(_rated(index, *each) for each in found))
            s = np.array(scores, dtype=np.float64)
            kinds = pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("cosine", pa.float64())]))
            columns = [batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(near, kinds)]
            yield pa.record_batch(columns, ["doc_id", "score", "predicted", "evidence"])

    return terms.mapInArrow(
        rate, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double>>"
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every document; texts are read for words once."""
    index, terms = fitted(docs, labels, keep=True)
    held = held_out(F.col("doc_id")).alias("held_out")
    return scored_terms(terms, index).select("doc_id", held, "score", "predicted", "evidence")
