"""Spelling variants by a dictionary of pairs of trie nodes.

The prefixes of all words are the nodes of a forward trie, their suffixes those of a reversed one, and each
node that several words pass has a number. A word stands under the pair (prefix node, suffix node) of
every place between two characters, and of every character left out. Words that leave out a
character and meet in a pair differ by a replaced one; a word that leaves one out and meets
one that does not has a character more. Nothing else is near, so the neighbours are exact; and a pair
holds at most as many words as there are letters, since its words agree in all but one.
Of a run of one letter only the first may be left out to shorten a word, so that no neighbour counts twice.

Nodes are told apart by 128-bit digests that grow with the word, so that a word of any length costs
its length, not its square. A node that only one word passes can join nothing and is left out.

Runs: ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased. Where 97 divides the CRC-32 of ``<doc_id>:<run>``, the
run loses the code point at that number modulo its length; without a doc_id it never does. Null and
empty texts have no words; repeated rows count as often as they come. A text is read as a stream and
its counts are handed on in bounded parts. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanefold.llm.common import own_columns, releasing, slices, stored, text_column
from lanefold.operators.sizing import dense_ordinal

# UTF-8 of U+00C0 to U+00FF is C3 80 to C3 BF, and C3 begins nothing else.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
EVERY = 97
TIMES = 2
HELD = 200_000


def variant(run: bytes, code: int) -> bytes:
    """The run, or without one of its code points where ``EVERY`` divides ``code``."""
    if code % EVERY:
        return run
    letters = run.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts and how often they come, rare ones too."""
    rows = own_columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("string"), "text")

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.record_batch(out, ["word", "n"])

        def count(own: Counter[bytes], start: int | None) -> None:
            for run, n in own.items():
                # No result has more bytes than its run, and all code points take one at least.
                if len(run) >= LEAST_LENGTH:
                    counts[run if start is None else variant(run, zlib.crc32(run, start))] += n
            own.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_column(part).cast(pa.binary()).to_pylist()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                    own: Counter[bytes] = Counter()
                    if len(text) < 1 << 20:
                        own.update(map(bytes.lower, RUN.findall(text)))
                    else:
                        for found in RUN.finditer(text):
                            own[found[0].lower()] += 1
                            if len(own) >= HELD:
                                count(own, start)
                                if len(counts) >= HELD:
                                    yield flushed()
                    count(own, start)
                    if len(counts) >= HELD:
                        yield flushed()
        if counts:
            yield flushed()

    return rows.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n): words by number, in the order of their code points."""
    often = occurrences(docs).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return dense_ordinal(often, [], ["word", "n"], "id").select("id", "word", "n")


def _path(letters: list[bytes], seed: int) -> list[bytes]:
    """The digests of all beginnings of ``letters``, the empty one included."""
    h = xxhash.xxh3_128(seed=seed)
    out = [h.digest()]
    for letter in letters:
        h.update(letter)
        out.append(h.digest())
    return out


def places(words: DataFrame) -> DataFrame:
    """(id, n, whole, first, prefix, suffix): each word at all places, whole or without the character there."""

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for id_, word, n in zip(*[batch.column(c).to_pylist() for c in ("id", "word", "n")]):
                letters = [c.encode() for c in word]
                prefixes, suffixes = _path(letters, 1), _path(letters[::-1], 2)[::-1]
                for i in range(len(letters) + 1):
                    rows.append((id_, n, True, True, prefixes[i], suffixes[i]))
                    if i < len(letters):
                        rows.append((id_, n, False, not i or letters[i] != letters[i - 1], prefixes[i], suffixes[i + 1]))
                    if len(rows) >= HELD:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        names = ["id", "n", "whole", "first", "prefix", "suffix"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return words.mapInArrow(work, "id bigint, n bigint, whole boolean, first boolean, prefix binary, suffix binary")


def nodes(at: DataFrame) -> DataFrame:
    """(digest, node): the nodes of both tries that at least two words pass, numbered."""
    once = at.where("whole")
    both = once.select(F.col("prefix").alias("digest")).unionByName(once.select(F.col("suffix").alias("digest")))
    shared = both.groupBy("digest").agg(F.count("*").alias("_words")).where("_words > 1").select("digest")
    return stored(shared.withColumn("node", F.monotonically_increasing_id()), "nodes")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with near ones their number, and (-n, id) of the most frequent."""
    at = stored(places(words), "places")
    numbered = nodes(at)
    forth = numbered.select(F.col("digest").alias("prefix"), F.col("node").alias("p"))
    back = numbered.select(F.col("digest").alias("suffix"), F.col("node").alias("s"))
    member = F.struct("whole", "first", (-F.col("n")).alias("less"), "id")
    pairs = at.join(forth, "prefix").join(back, "suffix").groupBy("p", "s").agg(F.collect_list(member).alias("_all"))
    each = pairs.where(F.size("_all") > 1).select("_all", F.explode("_all").alias("_one"))
    one = F.col("_one")
    replaced = lambda x: ~one["whole"] & ~x["whole"] & (x["id"] != one["id"])
    shorter = lambda x: ~one["whole"] & one["first"] & x["whole"]
    longer = lambda x: one["whole"] & ~x["whole"] & x["first"]
    near = F.filter("_all", lambda x: replaced(x) | shorter(x) | longer(x))
    each = each.select(one["id"].alias("id"), F.transform(near, lambda x: F.struct(x["less"].alias("less"), x["id"].alias("id"))).alias("_near"))
    each = each.where(F.size("_near") > 0).select("id", F.size("_near").alias("_n"), F.array_min("_near").alias("_best"))
    return each.groupBy("id").agg(F.sum("_n").alias("n_near"), F.min("_best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where following ``forms`` (id, form) ends. Each step at least doubles a count, so chains are short."""
    ends = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        next_ = ends.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        moved = ends.join(next_, F.col("root") == F.col("_id"), "left")
        moved = stored(moved.select("id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        if moved.where("_moved").isEmpty():
            return moved.select("id", "root")
        ends = moved.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(vocabulary(docs), "words")
    near = stored(neighbours(words), "near").select(F.col("id").alias("_id"), "n_near", F.col("best.id").alias("_form"), (-F.col("best.less")).alias("_form_n"))
    judged = words.join(near, F.col("id") == F.col("_id"), "left")
    leads = F.col("_form_n") >= TIMES * F.col("n")
    judged = judged.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("_form")).alias("form_id"), F.when(leads, F.col("_form_n")).alias("form_n"),
    )
    judged = stored(judged, "judged")
    ends = roots(judged.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    ends = ends.select(F.col("id").alias("_end"), F.col("root").alias("_root"))
    named = lambda id_, name: words.select(F.col("id").alias(id_), F.col("word").alias(name))
    out = judged.join(named("_f", "form"), F.col("form_id") == F.col("_f"), "left")
    out = out.join(ends, F.col("id") == F.col("_end"), "left").join(named("_r", "_root_word"), F.col("_root") == F.col("_r"), "left")
    return out.select("word", "form", F.coalesce("_root_word", "word").alias("root"), "n", "n_near", "form_n")


# The table of CRC-32 by its rule, the bytes of a run from its code points.
VARIANTS_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
    FROM range(256) AS r(i))),
runs AS MATERIALIZED (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE
    xor(list_reduce(
      flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) END AS h
  FROM each, crc),
results AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM coded),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
holes AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n AS m FROM holes AS x JOIN holes AS y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes AS x JOIN words AS y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM holes AS x JOIN words AS y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS tip, 0 AS depth FROM judged
  UNION ALL SELECT chain.word, judged.form, depth + 1 FROM chain JOIN judged ON chain.tip = judged.word WHERE judged.form IS NOT NULL)
SELECT word, form, arg_max(tip, depth) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM judged JOIN chain USING (word) GROUP BY word, form"""
