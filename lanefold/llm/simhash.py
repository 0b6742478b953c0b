"""SimHash near-duplicates by anchor points of a covering code.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of ``words``
words, repeats included; a fingerprint bit is 1 if set in more than half of the shingles'
XXH64. Fewer words are one shingle; no words, or a null text, give fingerprint zero.

Anchors are the code words of two perfect binary Golay codes side by side, over the upper 46 of the
64 bits: each 23 bits lie within 3 of exactly one code word. A fingerprint's home is the pair
of its nearest code words. If two fingerprints differ in d <= 2 bits, then either lies, block by
block, within 3 bits plus its share of d of the other's home. So every fingerprint is copied to
all anchors that near (some 60 of 16.8 million), and fingerprints are compared with the
homes of their anchor only. All links are found; none outside an anchor is looked at.

An anchor yields the connected stars among its members, not their pairs. Few members are compared
outright, many by flipping bits and looking up, so that a crowded anchor costs in proportion
to its members. Equal fingerprints are one node from the start, whatever their number.

Repeated rows are linked like copies. A null doc_id is carried along and never smallest; a
component of nothing else has a null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, releasing, slices, stored, text_column
from lanefold.llm.graph import components

WORDS = 3
SEED = 42
BITS = 2
FEW_MEMBERS = 4096

# The generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0b110001110101
_CHUNK = 2048


def fingerprint(text: bytes, words: int = WORDS) -> bytes:
    """The eight bytes of a text's fingerprint, highest first."""
    split = text.lower().split()
    if not split:
        return bytes(8)
    line = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(split) - words + 1)
    last = (ends - 1).tolist()[min(words, len(split)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n], last)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a long."""

    @releasing
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_column(part).cast(pa.binary()).to_pylist()
                fp = np.frombuffer(b"".join([fingerprint(t, words) for t in texts]), dtype=">i8")
                yield pa.record_batch([part.column("doc_id"), pa.array(fp.astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(rows, f"doc_id {kind}, fp bigint")


class Golay:
    """For each 11-bit syndrome: the nearest code word's offset, and the offsets of those 4 and 5 away."""

    def __init__(self):
        self.check = np.zeros(1 << 12, dtype=np.int64)  # of the upper 12 bits
        for bit in range(12):
            rest = 1 << (bit + 11)
            for k in range(22, 10, -1):
                if rest >> k & 1:
                    rest ^= GOLAY << (k - 11)
            self.check[1 << bit] = rest
        for m in range(1, 1 << 12):
            self.check[m] = self.check[m & (m - 1)] ^ self.check[m & -m]
        self.near, self.offsets, self.counts = None, {}, {}
        light = np.concatenate([self._words(w) for w in range(4)])
        self.near = np.zeros(1 << 11, dtype=np.int64)
        self.near[self.syndrome(light)] = light
        for w in (4, 5):
            e = self._words(w)
            s = self.syndrome(e)
            e = e[np.argsort(s, kind="stable")]
            self.counts[w - 3] = np.bincount(s, minlength=1 << 11)
            self.offsets[w - 3] = (np.cumsum(self.counts[w - 3]) - self.counts[w - 3], e)

    def _words(self, weight: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.check[x >> 11] ^ (x & 0x7FF)

    def anchors(self, x: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of the code words ``beyond`` the covering radius; 0 for the nearest one."""
        s = self.syndrome(x)
        if beyond == 0:
            return np.arange(len(x)), (x ^ self.near[s]) >> 11
        first, e = self.offsets[beyond]
        row, k = ragged(self.counts[beyond][s])
        return row, (x[row] ^ e[first[s][row] + k]) >> 11


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated ``counts`` times, and the number of each repeat."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


@lru_cache(maxsize=1)
def golay() -> Golay:
    return Golay()


def replicas(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, anchor, home) for all anchors that each fingerprint is compared at."""
    bits = fp.astype(np.int64).view(np.uint64)
    upper, lower = ((bits >> np.uint64(41)).astype(np.int64), ((bits >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.int64))
    code = golay()
    for a in range(BITS + 1):
        for b in range(BITS + 1 - a):
            row, first = code.anchors(upper, a)
            at, second = code.anchors(lower[row], b)
            yield row[at], (first[at] << 12) | second, a == b == 0


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect all fingerprints (column fp, distinct) within two bits of each other."""

    @releasing
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy()
            for i in range(0, len(all_fp), _CHUNK):
                fp = all_fp[i : i + _CHUNK]
                for row, anchor, home in replicas(fp):
                    yield pa.record_batch(
                        [pa.array(anchor.astype(np.int32)), pa.array(fp[row]), pa.repeat(home, len(row))], ["anchor", "fp", "home"]
                    )

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in _and_end(batches):
            if batch is not None:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home")))
                if held[0][0][0] == held[-1][0][-1]:
                    continue  # one anchor goes on
            if not held:
                continue
            anchor, fp, home = (np.concatenate(x) for x in zip(*held))
            # The last anchor may go on in the next batch.
            whole = len(anchor) if batch is None else np.searchsorted(anchor, anchor[-1])
            held = [] if batch is None else [(anchor[whole:], fp[whole:], home[whole:])]
            u, v = _stars(anchor[:whole], fp[:whole], home[:whole])
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return (
        nodes.select("fp")
        .mapInArrow(copy, "anchor int, fp bigint, home boolean")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, "u bigint, v bigint")
    )


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _stars(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked member of an anchor to the least one it is connected with there."""
    us, vs = [], []
    if len(anchor):
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(first, len(anchor)))
        homes = np.add.reduceat(home.astype(np.int64), first)
        for i in np.flatnonzero((size > 1) & (homes > 0)).tolist():
            part = slice(first[i], first[i] + size[i])
            members = np.unique(fp[part])
            root = np.arange(len(members))
            for a, b in _near(members, np.unique(fp[part][home[part]])):
                _unite(root, a, b)
            root = _settled(root, np.arange(len(members)))
            far = root != np.arange(len(members))
            us.append(members[far])
            vs.append(members[root[far]])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _near(members: np.ndarray, homes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of members within ``BITS`` of a home; both arrays are sorted."""
    at = np.searchsorted(members, homes)
    if len(members) <= FEW_MEMBERS:
        own, others = homes.view(np.uint64), members.view(np.uint64)  # of a signed number, its absolute value is counted
        for i in range(0, len(homes), 256):
            h, m = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ others[None, :]) <= BITS)
            yield at[i + h], m
        return
    one = [np.int64(np.uint64(1 << b).astype(np.int64)) for b in range(64)]
    for flip in [*one, *[a ^ b for a, b in combinations(one, 2)]]:
        asked = homes ^ flip
        found = np.minimum(np.searchsorted(members, asked), len(members) - 1)
        hit = members[found] == asked
        yield at[hit], found[hit]


def _settled(root: np.ndarray, of: np.ndarray) -> np.ndarray:
    of = root[of]
    while (up := root[of]).tobytes() != of.tobytes():
        of = up
    return of


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair, the smaller root on top."""
    while len(a):
        a, b = _settled(root, a), _settled(root, b)
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(root, a, b)


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach from each document."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = placed.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(of_print, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint in 16 hexadecimal digits."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
