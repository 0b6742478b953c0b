"""Byte-pair encoding and decoding of whole texts, long ones in parallel.

A long text is cut in halves, and these again, until each piece is short. The pieces are rows
of their own and are encoded by different tasks; then the neighbours of a text are joined in
a tree. Each join re-encodes a growing window around the cut until both sides agree (see
``tokens``), so the ids are those of the whole text, also where nothing splits it.

Null texts count as empty and get no ids; rows that repeat give as many results. ``doc_id`` may
be null and is only carried along. Other columns are ignored. A text of one piece never leaves
its task; of a longer one only its own pieces meet.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, releasing, slices, text_column
from lanefold.llm.tokens import encoder

PIECE_CHARS = 32_768


def encode(docs: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = own_columns(docs, doc_id="doc_id", text="text")
    is_long = F.coalesce(F.length("text") > piece_chars, F.lit(False))

    @releasing
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder(path).encode(text_column(part))
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                pieces = encoder(path).halves(one.column("text")[0].as_py(), piece_chars)
                n = len(pieces)
                yield pa.record_batch(
                    [
                        pa.repeat(one.column("row")[0], n),
                        pa.repeat(one.column("doc_id")[0], n),
                        pa.array(range(n), pa.int32()),
                        pa.array(pieces, pa.string()),
                    ],
                    ["row", "doc_id", "piece", "text"],
                )

    @releasing
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes = [pickle.dumps(encoder(path).node(t)) for t in part.column("text").to_pylist()]
                columns = [part.column(c) for c in ("row", "doc_id", "piece")]
                yield pa.record_batch([*columns, pa.array(nodes, pa.binary())], ["row", "doc_id", "piece", "node"])

    def settle(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("piece")
        ids = encoder(path).settle([pickle.loads(x) for x in pieces["node"].to_pylist()])
        return pa.table({"doc_id": pieces["doc_id"].slice(0, 1), "ids": pa.array([ids], pa.binary())})

    out = f"doc_id {kind}, ids binary"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = (
        rows.where(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"row bigint, doc_id {kind}, piece int, text string")
        .repartition(tasks, "row", "piece")
        .mapInArrow(leaves, f"row bigint, doc_id {kind}, piece int, node binary")
        .groupBy("row")
        .applyInArrow(settle, out)
    )
    return rows.where(~is_long).mapInArrow(short, out).unionByName(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): what the ids say, special tokens included.

    The vocabulary file names no decoder, for which the library puts a space between tokens.
    """

    @releasing
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [" ".join([names[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(texts, f"doc_id {kind}, ids binary, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded texts, decoded again here."""

    @releasing
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(path)
        spoken, decimal = [x.encode() for x in names], [str(i).encode() for i in range(len(names))]
        sha = lambda words, ids: hashlib.sha256(b" ".join([words[i] for i in ids])).hexdigest()
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = [np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([sha(decimal, x) for x in ids], pa.string()),
                        pa.array([sha(spoken, x) for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(rows, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _names(path: str) -> list[str]:
    tokenizer = encoder(path).tokenizer
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
