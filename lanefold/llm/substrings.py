"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text: shift left, add the byte's gear. Its upper
bits depend on the last 32 bytes alone, its middle ones on 16, so a chunk ends where the text itself says so, and an
insertion moves only the ends next to it. Chunks have ``MIN_CHUNK`` to ``MAX_CHUNK`` bytes, some
``MIN_CHUNK + RATE`` on average; they go by a 64-bit digest. The document of the least doc_id
that holds a chunk keeps it. In the others, adjoining chunks of that kind make up runs. A run is only where a
passage has been met: it grows byte by byte over as much of the ``CONTEXT`` bytes next to it as its
holder has, too, and runs that then meet are one. Those of at least ``MIN_WORDS`` words go, or of
``MIN_BYTES`` bytes where words are longer or not spaced; a word that a run's end cuts stays. So a passage of
51 words goes whole, at the most without a word at each end. A digest that two chunks share by chance
has nothing around it that agrees, and cuts nothing.

Chunks that a text repeats within itself are left alone, unless another document has them first.
Rows of one doc_id are one document, whatever their texts: they never shorten each other, and copies
are treated alike. Null and empty texts have no chunks; rows without doc_id stay as they are. A chunk in any share of the documents is combined on the map side, and
the join that follows can be split; only a document's own chunks ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import forgetting, shielded, slices, stored, text_column

MIN_CHUNK, RATE, MAX_CHUNK = 12, 16, 256
MIN_WORDS, MIN_BYTES = 49, 600
CONTEXT = 128
WINDOW = 32
GEAR_SEED = 7
SLICE_BYTES = 2 << 20

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), GEAR_SEED) for b in range(256)], dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; each text, between two offsets, starts from nothing."""
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1) * WINDOW, sizes)
    h = np.zeros(len(data) + (len(sizes) + 1) * WINDOW, dtype=np.uint32)
    h[at] = GEAR[data]
    step = 1
    while step < WINDOW:  # sums over 2, 4, ... 32 bytes, each shifted by its distance
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h[at]


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end, in all texts in turn. No chunk ends within a character."""
    starts_character = np.append((data[1:] & 0xC0) != 0x80, True)
    hashes = gear_hashes(data, offsets) << np.uint32(WINDOW // 2)  # what the last 16 bytes say
    wanted = (hashes < np.uint32(2**32 // RATE)) & starts_character
    hashes[~starts_character] = 2**32 - 1
    last_bytes = np.zeros(len(data), dtype=bool)
    last_bytes[offsets[1:][np.diff(offsets) > 0] - 1] = True
    stops = np.flatnonzero(wanted | last_bytes) + 1
    ends, begin = [], 0
    final = last_bytes[stops - 1].tolist()
    for stop, is_final in zip(stops.tolist(), final):
        while stop - begin > MAX_CHUNK:
            # No end of its own for long, as in periodic text: the least hash is one, too.
            begin += MIN_CHUNK + int(hashes[begin + MIN_CHUNK - 1 : begin + MAX_CHUNK].argmin())
            ends.append(begin)
        if is_final or stop - begin >= MIN_CHUNK:
            ends.append(stop)
            begin = stop
    return np.array(ends, dtype=np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, ident, d, place): the chunks of every text, start << 16 | size in bytes.

    ``ident`` tells apart texts under one id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("ident"), "text").where(
        "doc_id IS NOT NULL AND text <> ''"
    )

    @forgetting
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = text_column(part)
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                raw = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()
                offsets = offsets - offsets[0]
                ends = chunk_ends(np.frombuffer(raw, np.uint8), offsets)
                begins = np.append(0, ends[:-1])
                digest = xxhash.xxh3_64_intdigest
                names = np.array([digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], dtype=np.uint64)
                row = np.searchsorted(offsets, begins, side="right") - 1
                of = pa.array(row)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(of),
                        part.column("ident").take(of),
                        pa.array(names.view(np.int64)),
                        pa.array(((begins - offsets[row]) << 16) | (ends - begins)),
                    ],
                    ["doc_id", "ident", "d", "place"],
                )

    return rows.mapInArrow(cut, f"doc_id {kind}, ident bigint, d bigint, place bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, ident, runs): of each document, the runs of chunks that earlier documents hold.

    ``runs`` are (start, end, ids, before, after): places in bytes, the documents that keep the chunks, and
    what the first chunk's holder has before it and the last one's after it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = chunks(docs)
    # Written out, so that the join has an exchange on either side and a hot chunk can be split.
    firsts = stored(
        cut.groupBy("d")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first <> last")
        .select(F.col("d").alias("_d"), "first"),
        "chunks",
    )
    shared = stored(cut.join(firsts, F.col("d") == F.col("_d")).drop("_d"), "shared")
    part = F.struct(F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("size"), "first", "d")
    again = shared.where("doc_id <> first").groupBy("doc_id", "ident").agg(F.sort_array(F.collect_set(part)).alias("parts"))
    ends = f"doc_id {kind}, ident bigint, start bigint, end bigint, ids array<{kind}>, left bigint, right bigint"
    met = stored(again.mapInArrow(_adjoined, ends), "runs")
    wanted = met.select(F.explode(F.array("left", "right")).alias("_d")).distinct()
    holders = (
        shared.where("doc_id = first")
        .join(wanted, F.col("d") == F.col("_d"), "left_semi")
        .groupBy("d", "doc_id")
        .agg(F.min(F.struct("ident", "place")).alias("at"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("at.ident").alias("_ident"))
        .agg(F.collect_list(F.struct("d", F.col("at.place").alias("place"))).alias("places"))
    )
    texts = docs.select("doc_id", "text").join(holders, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_ident")))
    around = texts.select("text", "places").mapInArrow(_surroundings, "d bigint, before binary, after binary")
    around = stored(around.dropDuplicates(["d"]), "around")  # equal rows of the holder say the same
    left = around.select(F.col("d").alias("_left"), "before")
    right = around.select(F.col("d").alias("_right"), "after")
    both = met.join(left, F.col("left") == F.col("_left")).join(right, F.col("right") == F.col("_right"))
    found = both.groupBy("doc_id", "ident").agg(F.collect_list(F.struct("start", "end", "ids", "before", "after")).alias("runs"))
    # Written out, so that the disk doesn't hold what these joins shuffle and the texts at a time.
    return stored(found, "passages")


@forgetting
def _adjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of adjoining chunks."""
    for batch in batches:
        names = ["doc_id", "ident", "start", "end", "ids", "left", "right"]
        out = {c: [] for c in names}
        for doc_id, ident, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ident", "parts"))):
            k = 0
            while k < len(parts):
                first = k
                k += 1
                while k < len(parts) and parts[k]["start"] == parts[k - 1]["start"] + parts[k - 1]["size"]:
                    k += 1
                run = parts[first:k]
                row = (doc_id, ident, run[0]["start"], run[-1]["start"] + run[-1]["size"], sorted({p["first"] for p in run}), run[0]["d"], run[-1]["d"])
                for c, x in zip(names, row):
                    out[c].append(x)
        kind = batch.schema.field("doc_id").type
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(out[c], t) for c, t in zip(names, types)], names)


@forgetting
def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands next to each of a text's chunks that are asked for."""
    for batch in batches:
        d, before, after = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            raw = text.encode()
            for p in places:
                start, end = p["place"] >> 16, (p["place"] >> 16) + (p["place"] & 0xFFFF)
                d.append(p["d"])
                before.append(raw[max(0, start - CONTEXT) : start])
                after.append(raw[end : end + CONTEXT])
        yield pa.record_batch([pa.array(d, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["d", "before", "after"])


def agreeing(a: bytes, b: bytes) -> int:
    """How many bytes two stretches have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def grown(found: list[dict], raw: bytes) -> list[tuple[int, int, set]]:
    """(start, end, ids) of runs as far as their holders agree, joined where they meet."""
    out: list[tuple[int, int, set]] = []
    for r in sorted(found, key=lambda r: (r["start"], r["end"])):
        a, b = r["start"], r["end"]
        a -= agreeing(raw[max(0, a - CONTEXT) : a][::-1], r["before"][::-1])
        b += agreeing(raw[b : b + CONTEXT], r["after"])
        if out and a <= out[-1][1]:
            begin, end, ids = out.pop()
            a, b, ids = begin, max(b, end), ids | set(r["ids"])
        else:
            ids = set(r["ids"])
        out.append((a, b, ids))
    return out


def runs(found: list[dict], raw: bytes, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> list[tuple[int, int, set]]:
    """(start, end, ids) in bytes of what is to be cut from a text, to whole words."""
    out = []
    for begin, end, ids in grown(found, raw):
        # A word cut by the run's ends stays, unless it is long enough to be no word.
        a, b = begin, end
        while 0 < a < min(end, begin + 64) and not _SPACE[raw[a - 1]]:
            a += 1
        while len(raw) > b > max(begin, end - 64) and not _SPACE[raw[b]]:
            b -= 1
        a = begin if a >= begin + 64 else a
        b = end if b <= end - 64 else b
        while a < b and raw[a] & 0xC0 == 0x80:  # no end within a character
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b and (b - a >= min_bytes or len(raw[a:b].split()) >= min_words):
            out.append((a, b, ids))
    return out


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from text, and removed_spans, removed_chars and kept_in.

    Spans are (start, end) in characters of the text before; ``kept_in`` lists the documents that
    still hold the passages. Columns of these names in ``docs`` are replaced.
    """
    added = ["removed_spans", "removed_chars", "kept_in"]
    return shielded(docs, ("doc_id", "text"), added, lambda rows: _deduplicated(rows, added, min_words))


def _deduplicated(docs: DataFrame, added: list[str], min_words: int) -> DataFrame:
    kept = docs.columns
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated(docs).select(F.col("doc_id").alias("_id"), F.col("ident").alias("_ident"), F.col("runs").alias("_runs"))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_ident")), "left")
    rows = rows.select(*kept, "_runs")

    @forgetting
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans, removed, holders = [], [], []
            for i, found in enumerate(batch.column("_runs").to_pylist()):
                raw = (texts[i] or "").encode()
                gone = runs(found or [], raw, min_words)
                places, left, at, chars = [], [], 0, 0
                for a, b, _ in gone:
                    left.append(raw[at:a])
                    chars += len(raw[at:a].decode())
                    n = len(raw[a:b].decode())
                    places.append((chars, chars + n))
                    chars += n
                    at = b
                if gone:
                    texts[i] = (b"".join(left) + raw[at:]).decode()
                spans.append([{"start": a, "end": b} for a, b in places])
                removed.append(sum(b - a for a, b in places))
                holders.append(sorted({d for *_, ids in gone for d in ids if d is not None}))
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "text": pa.array(texts, pa.string()),
                "removed_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "removed_chars": pa.array(removed, pa.int64()),
                "kept_in": pa.array(holders, pa.list_(batch.schema.field("doc_id").type)),
            }
            yield pa.record_batch([columns[c] for c in [*kept, *added]], [*kept, *added])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(
        cut,
        f"{fields}, removed_spans array<struct<start:bigint,end:bigint>>, removed_chars bigint, kept_in array<{kind}>",
    )


def shortened(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_spans, removed_chars, kept_in) of the documents that lose a passage."""
    return deduplicated(docs.select("doc_id", "text")).where("removed_chars > 0")
