"""Token ids as the ``tokenizers`` library gives them, for many texts and for very long ones.

White space ends every pre-token of the vocabularies meant here, so the ids of a text are
those of its words in turn. Words repeat, so the distinct ones of a batch are encoded at once.

Text that nothing splits is a ``Run``. Long ones are cut into halves and put together again by
``Runs.join``, which re-encodes a growing window around the cut until it holds a token of the
left side and a token of the right side unchanged. Byte-pair encoding has the property that a
sequence of tokens is the encoding of its text if and only if each neighbouring pair is; with
both sides met, every pair comes from one of the three encodings, and the result is exact.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lanefold.llm.common import per_row, resident

LEAF_CHARS = 4096
BATCH_WORD_BYTES = 64

# The pre-token pattern of the vocabulary that the batch path knows (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = " \t\n\v\f\r"
_DONE = np.int64(1) << 62


class Run(NamedTuple):
    """Unsplit, normalised text with its tokens and the characters each covers."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Closed(NamedTuple):
    """Text with a separator in it: the run before the first one, what is settled, the run after the last."""

    head: Run
    ids: bytes
    tail: Run


def _u32(ids: Sequence[int]) -> bytes:
    return array("I", ids).tobytes()


class PairTable:
    """Rank and result of merging two token ids, looked up for many pairs at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        m = np.array(merges, dtype=np.int64).reshape(-1, 3)
        keys, self.merged = (m[:, 0] << 20) | m[:, 1], m[:, 2]
        left = np.arange(len(keys))
        self.levels = []  # what a level cannot hold, the next one does
        while len(left):
            bits = max(8, int(len(left)).bit_length() + 4)
            factor = np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * len(self.levels))
            slot = (keys[left].astype(np.uint64) * factor) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            held, ranks = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
            held[slot[first]], ranks[slot[first]] = keys[left[first]], left[first]
            self.levels.append((factor, np.uint64(64 - bits), held, ranks))
            left = np.delete(left, first)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``_DONE`` where nothing merges it."""
        keys = (a << 20) | b
        out = np.full(len(keys), _DONE, dtype=np.int64)
        left = np.arange(len(keys))
        for factor, shift, held, ranks in self.levels:
            slot = (keys[left].astype(np.uint64) * factor) >> shift
            hit = held[slot] == keys[left]
            out[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        return out


class WordEncoder:
    """Ids of whole texts under a tokenizer file, special tokens recognised but none added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # The same for text that is normalised already and holds no special token.
        self.inner = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "normalizer": None, "truncation": None, "padding": None}))
        separators = "|".join([f"[{_SPACE}]+", *map(re.escape, self.specials)])
        self.separator = re.compile(separators)

        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.batched = model.get("end_of_word_suffix") == "</w>" and cut.get("pattern") == {"Regex": WORD_PATTERN}
        if self.batched:
            ids = model["vocab"]
            symbol = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            plain = {b: chr(b) for b in range(0x21, 0x7F)}
            for c in range(0xC0, 0x100):  # the bytes of these letters
                plain |= dict(zip(chr(c).encode(), symbol.pre_tokenize_str(chr(c))[0][0]))
            self.symbol = np.zeros((2, 256), dtype=np.int64)
            for b, c in plain.items():
                self.symbol[:, b] = ids[c], ids[c + "</w>"]
            pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
            self.pairs = PairTable([(ids[a], ids[b], ids[a + b]) for a, b in pairs])

    # Words

    def word(self, word: str) -> bytes:
        if len(word) > LEAF_CHARS:
            return self.long_word(word)
        return _u32(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and where each word's begin."""
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        size = np.diff(bounds)
        quick = np.zeros(len(words), dtype=bool)
        if self.batched:
            # Kinds of byte: letter, digit, other, and what the batch path leaves alone.
            after = np.append(data[1:], 0)
            before = np.append(np.uint8(0), data[:-1])
            lead = (data == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
            trail = (before == 0xC3) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
            low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
            low = low + np.where(trail & (data < 0x9F), 32, 0).astype(np.uint8)
            kind = np.full(len(data), 3, dtype=np.int8)
            kind[((low >= 97) & (low <= 122)) | lead | trail] = 1
            kind[(data >= 48) & (data <= 57)] = 2
            odd = ((data < 0x21) | (data > 0x7E)) & ~lead & ~trail | (data == 39)
            odd |= (data == 60) & (after == 124)  # as special tokens begin
            quick = (per_row(odd, bounds) == 0) & (size <= BATCH_WORD_BYTES)
        if not quick.any():
            flat, counts = np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        else:
            of = np.repeat(np.arange(len(words)), size)
            keep = quick[of]
            of, low, kind = of[keep], low[keep], kind[keep]
            new = np.ones(len(of), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            last = np.append(new[1:], True)
            flat, n = self._merge(self.symbol[last.astype(np.int8), low], np.flatnonzero(new))
            counts = np.bincount(of[new], weights=n, minlength=len(words)).astype(np.int64)
        rest = np.flatnonzero(~quick & (size > 0))
        if len(rest):
            odd_ids = [np.frombuffer(self.word(w), dtype="<u4") for w in words.take(pa.array(rest)).to_pylist()]
            at = (np.cumsum(counts) - counts)[rest]
            flat = np.insert(flat, np.repeat(at, [len(x) for x in odd_ids]), np.concatenate(odd_ids))
            counts[rest] = [len(x) for x in odd_ids]
        return flat, np.append(0, np.cumsum(counts))

    def _merge(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of all pre-tokens at once: each round, the best pair of each one."""
        n = len(starts)
        of = np.repeat(np.arange(n), np.diff(np.append(starts, len(ids))))
        done_ids, done_of = [], []
        rank = self._ranks(ids, of, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            key = np.minimum.reduceat(np.where(rank == _DONE, _DONE, (rank << 31) | np.arange(len(ids))), first)
            over = np.repeat(key == _DONE, np.diff(np.append(first, len(ids))))
            at = key[key != _DONE] & 0x7FFFFFFF
            ids[at] = self.pairs.merged[rank[at]]
            done_ids.append(ids[over])
            done_of.append(of[over])
            keep = ~over
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            ids, of, rank, at = ids[keep], of[keep], rank[keep], moved[at]
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._ranks(ids, of, changed)
        if not done_ids:
            return ids, np.zeros(n, dtype=np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)

    def _ranks(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), _DONE, dtype=np.int64)
        ok = np.flatnonzero(at + 1 < len(ids))
        ok = ok[of[at[ok]] == of[at[ok] + 1]]
        out[ok] = self.pairs.ranks(ids[at[ok]], ids[at[ok] + 1])
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin. No text may be null."""
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        ids, begin = self.words(coded.dictionary)
        at = coded.indices.to_numpy()
        count = np.diff(begin)[at]
        ends = np.append(0, np.cumsum(count))
        flat = ids[np.repeat(begin[at] - ends[:-1], count) + np.arange(ends[-1])]
        return flat.astype("<u4"), ends[bounds - bounds[0]]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        flat, bounds = self.encode_flat(texts)
        data, at = flat.tobytes(), (bounds * 4).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]

    # Unsplit text

    def run(self, text: str) -> Run:
        """A leaf: normalised text without separators, encoded as it stands."""
        coded = self.inner.encode(text, add_special_tokens=False)
        spans = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
        return Run(text, np.array(coded.ids, dtype="<u4"), spans[:, 0], spans[:, 1])

    def join(self, left: Run, right: Run, width: int = 16) -> Run:
        """The run of both texts together."""
        cut, text = len(left.text), left.text + right.text
        if not left.text or not right.text:
            return right if not left.text else left
        starts, ends = right.starts + cut, right.ends + cut
        while True:
            lo, hi = max(0, cut - width), min(len(text), cut + width)
            w = self.run(text[lo:hi])
            ws, we = w.starts + lo, w.ends + lo
            # A token at an artificial end carries the mark of a word's end: those don't count.
            a = (0, 0) if lo == 0 else _shared(left.ids, left.starts, left.ends, w.ids, ws, we, lo, cut - 1)
            b = (len(right.ids), len(w.ids)) if hi == len(text) else _shared(right.ids, starts, ends, w.ids, ws, we, cut, hi - 1, last=True)
            if a is not None and b is not None and a[1] <= b[1]:
                (i, k), (j, m) = a, b
                return Run(
                    text,
                    np.concatenate([left.ids[:i], w.ids[k:m], right.ids[j:]]),
                    np.concatenate([left.starts[:i], ws[k:m], starts[j:]]),
                    np.concatenate([left.ends[:i], we[k:m], ends[j:]]),
                )
            width *= 2

    def tree(self, nodes: list, join) -> object:
        """Neighbours joined in pairs, level by level."""
        while len(nodes) > 1:
            nodes = [join(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def long_run(self, text: str) -> Run:
        """The run of a normalised text of any length."""
        leaves = [text[i : i + LEAF_CHARS] for i in range(0, len(text), LEAF_CHARS)] or [""]
        return self.tree([self.run(x) for x in leaves], self.join)

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def long_word(self, word: str) -> bytes:
        out, at = [], 0
        for m in [*self.separator.finditer(word), None]:
            out.append(self.long_run(self.normal(word[at : m.start() if m else len(word)])).ids.tobytes())
            if m:
                out.append(_u32([self.tokenizer.token_to_id(m.group())]))
                at = m.end()
        return b"".join(out)

    # Pieces of a long text

    def node(self, piece: str) -> Run | Closed:
        """What is known of a text that may go on to either side."""
        first = self.separator.search(piece)
        if first is None:
            return self.long_run(self.normal(piece))
        last = first
        for last in self.separator.finditer(piece, first.start()):
            pass
        inside = self.encode(pa.array([piece[first.start() : last.end()]]))[0]
        return Closed(self.long_run(self.normal(piece[: first.start()])), inside, self.long_run(self.normal(piece[last.end() :])))

    def concat(self, a: Run | Closed, b: Run | Closed) -> Run | Closed:
        if isinstance(a, Run):
            return self.join(a, b) if isinstance(b, Run) else b._replace(head=self.join(a, b.head))
        if isinstance(b, Run):
            return a._replace(tail=self.join(a.tail, b))
        return Closed(a.head, a.ids + self.join(a.tail, b.head).ids.tobytes() + b.ids, b.tail)

    def settle(self, nodes: list[Run | Closed]) -> bytes:
        """The ids of a whole text from its pieces in order."""
        whole = self.tree(nodes, self.concat)
        if isinstance(whole, Run):
            return whole.ids.tobytes()
        return whole.head.ids.tobytes() + whole.ids + whole.tail.ids.tobytes()

    def halves(self, text: str, max_chars: int) -> list[str]:
        """The text cut in halves until each is short, only where that changes no character.

        Not before a mark that could combine with the character before it, nor inside the
        string of a special token; a part without such a place stays whole.
        """
        if len(text) <= max_chars:
            return [text]
        cut = len(text) // 2
        longest = max([2, *map(len, self.specials)])
        while cut < len(text):
            around = text[max(0, cut - longest + 1) : cut + longest - 1]
            inside = [s for s in self.specials if s in around]
            if not inside and not unicodedata.category(text[cut]).startswith("M") and not 0x1100 <= ord(text[cut]) <= 0x11FF:
                break
            cut += 1
        if cut >= len(text):
            return [text]
        return [*self.halves(text[:cut], max_chars), *self.halves(text[cut:], max_chars)]


def _shared(ids, starts, ends, w_ids, w_starts, w_ends, lo, hi, last=False):
    """Indices of a token that both encodings hold at one place in [lo, hi), far from the cut."""
    i = np.flatnonzero(_alone(starts, ends) & (starts >= lo) & (ends <= hi))
    k = np.flatnonzero(_alone(w_starts, w_ends) & (w_starts >= lo) & (w_ends <= hi))
    if not len(i) or not len(k):
        return None
    key = lambda n, s, e, x: {(a, b, c): y for a, b, c, y in zip(s[x].tolist(), e[x].tolist(), n[x].tolist(), x.tolist())}
    mine, theirs = key(ids, starts, ends, i), key(w_ids, w_starts, w_ends, k)
    both = mine.keys() & theirs.keys()
    if not both:
        return None
    at = max(both) if last else min(both)
    return mine[at], theirs[at]


def _alone(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that share no character with a neighbour (a character can be several tokens)."""
    ok = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        apart = starts[1:] >= ends[:-1]
        ok[1:] &= apart
        ok[:-1] &= apart
    return ok


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process."""
    return resident(path, lambda: WordEncoder(path))
