"""Encoding against the library, packing against its own rules and a sequential best fit."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import DOCS, SMALL, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lanefold.llm import bpe, packing
from lanefold.llm.common import table
from lanefold.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

ODD = [
    None, "", " ", "\n\t", "a", "The the THE", "don't they're I'll 'tis", "!?'s", "12 3.4", "éèà ÉÈÀ ß ÿ × ÷", "é ̧́",
    "漢字かな가나다", "가ᅡᆨ", "İSß Σσς", "👍🏽❤️", "<|startoftext|>a<|endoftext|>", "<|STARTOFTEXT|>", "x<|b", "a" * 70, "a b c", "a\x1cb",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_as_the_library():
    e = encoder(PATH)
    got = e.encode(pa.array([t or "" for t in ODD]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids(t) for t in ODD]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab'srelvtdm ABé́漢1!?<|\n", max_size=80), st.sampled_from([3, 7, 20]))
def test_pieces_settle_to_the_whole(text, size):
    e = encoder(PATH)
    cut = e.halves(text, size)
    assert "".join(cut) == text
    assert np.frombuffer(e.settle([e.node(p) for p in cut]), "<u4").tolist() == ids(text)
    assert np.frombuffer(e.encode(pa.array([text]))[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "汉" * 9_000, "<|startoftext|>" * 900 + "x" * 9_000])
def test_long_unsplit_text(text):
    assert np.frombuffer(encoder(PATH).word(text), "<u4").tolist() == ids(text)


def test_documents_encode_and_decode(spark):
    r = random.Random(5)
    long = ["".join(r.choice("abc defgh'") for _ in range(3_000)), "z" * 2_500]
    texts = [*ODD, *long, long[0], None]
    df = clashing(documents(spark, texts)).repartition(3)
    coded = bpe.encode(df, PATH, piece_chars=300)
    got = {r.doc_id: r for r in bpe.digests(coded, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(ids(t))
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids(t))).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids(t), skip_special_tokens=False).encode()).hexdigest()
    decoded = {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()}
    assert all(decoded[i] == LIBRARY.decode(ids(t), skip_special_tokens=False) for i, t in enumerate(texts))
    null_id = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert bpe.digests(bpe.encode(null_id, PATH), PATH).first().n_tokens == 2
    assert bpe.encode(df.limit(0), PATH).count() == 0


def sequential(lengths, capacity):
    """Plain best-fit decreasing: the number of bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            best = min(fits, key=lambda i: bins[i])
            bins[best] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_packing_by_counts_is_best_fit_decreasing(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    left, seen = {}, {n: 0 for n in counts}
    for p in packing.best_fit_decreasing(counts, capacity):
        assert p.rank == seen[p.length]
        seen[p.length] += p.bins * p.each
        for b in range(p.sequence, p.sequence + p.bins):
            assert capacity - left.get(b, capacity) == p.offset
            left[b] = left.get(b, capacity) - p.length * p.each
            assert left[b] >= 0
    assert seen == counts
    assert sorted(left.values()) == sequential(lengths, capacity)


def test_open_bins_finds_the_tightest():
    bins = packing.OpenBins(100)
    assert bins.tightest(1) is None
    for r in (7, 50, 99):
        bins.put(r, 0, 1)
    assert [bins.tightest(n) for n in (1, 7, 8, 51, 100)] == [7, 7, 50, 99, None]
    bins.take(50)
    assert bins.tightest(8) == 99


def test_packed_documents(spark):
    texts = ["a b c " * 40, None, "", "x " * 900, "y z", "y z", "word " * 333]
    df = clashing(documents(spark, texts)).repartition(3)
    rows = packing.best_fit_packing(df, PATH, capacity=64).collect()
    whole = {i: [*ids(t), 1] for i, t in enumerate(texts)}
    for i, expected in whole.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(expected) // 64)))
        for r in mine:
            piece = expected[r.start : r.start + r.length]
            assert r.start == 64 * r.piece and len(piece) == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(sequential([r.length for r in rows], 64))
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_whole_small_table(spark):
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id: r.n_tokens for r in bpe.digests(bpe.encode(docs, PATH), PATH).collect()}
    assert all(got[r.doc_id] == len(ids(r.text)) for r in docs.collect())
