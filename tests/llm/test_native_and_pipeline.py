"""Operators with SQL against that SQL on difficult rows, the pipeline's stages, and the registry."""

import re

import corpus_pipeline
import duckdb
import pytest
from helpers import DOCS, SMALL, clashing, documents, words

import __spark_entry__ as driver
from lanefold.llm import chat, rules, urls
from lanefold.llm.common import table

MIDDLE = "/root/testdata/sf0.01"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def in_duckdb(sql, **tables):
    db = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()  # noqa: F841
        kinds = ", ".join(f"{c} {'BIGINT' if t == 'bigint' else 'VARCHAR'}" for c, t in df.dtypes)
        db.execute(f"CREATE TABLE {name} ({kinds})")
        if len(frame):
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()])
    return plain(db.execute(sql).fetchall())


# Rules

TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x", "# $ %", "line\nline\n\nline \nline", "é漢 👍 a\x0bb\x0cc\r\nd",
    "tail a b c mid a b c end", " ".join(words(80, 1)), " ".join(words(20, 2) * 5), "w*** " * 60, "short line here\n" * 40, "ab " * 3_000,
]


def test_ledger_against_sql(spark):
    docs = documents(spark, [*TEXTS, TEXTS[-1], TEXTS[12]])
    got = rules.judge(clashing(docs))
    assert plain(got.collect()) == in_duckdb(rules.JUDGE_SQL, documents=docs)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[12] and not any(kept[i] for i in (0, 1, 3, 13, 14, 15, 16))
    assert rules.judge(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert rules.judge(null_id).first().n_words == 3


def test_filters_above_the_ledger_do_no_work_twice(spark):
    plan = rules.ledger(documents(spark, TEXTS)).where("n_repeat_words > 3 AND failed = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1


def test_ablations(spark):
    entries = rules.ledger(documents(spark, TEXTS))
    rows = {r.failed for r in entries.select("failed").collect()}
    failed = [r.failed for r in entries.collect()]
    names = [n for n, _ in rules.RULES]
    got = rules.ablations(entries).collect()
    assert len(got) == sum(map(len, rules.POLICIES.values())) and rows
    for r in got:
        m, bit = rules.mask(rules.POLICIES[r.policy]), 1 << names.index(r.rule)
        assert r.docs == len(failed) and r.failing == sum(f & bit != 0 for f in failed)
        assert r.failing_alone == sum(f & m == bit for f in failed)
        assert (r.kept, r.kept_without) == (sum(f & m == 0 for f in failed), sum(f & m & ~bit == 0 for f in failed))
    assert rules.ablations(entries.limit(0)).count() == 0


# Dialogues


@pytest.fixture
def dialogue(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi\nall"), (1, 2, "bob", "<|im_end|> no"), (1, 3, "ann", None), (1, 3, "ann", None),
        (2, None, None, "first"), (2, 0, "a\n<b>|", "x"), (2, 0, "a\n<b>|", "y"), (None, 5, "user", "z"), (3, 0, "system", "alone"), (4, 1, "é", "漢"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rotation_against_sql(spark, dialogue):
    got = chat.rotated(clashing(dialogue))
    assert plain(got.collect()) == in_duckdb(chat.ROTATED_SQL, conversations=dialogue)
    assert chat.rotated(dialogue.limit(0)).count() == 0


def test_masks_cover_what_the_assistant_says(dialogue):
    rows = chat.rotate(dialogue).collect()
    assert {(r.conv_id, r.view) for r in rows} == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "a__b__"), (None, "user"), (4, "é")}
    for r in rows:
        said = [r.text[s.start : s.end] for s in r.loss_spans]
        assert said == [x for x in re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>)\n", r.text, re.S)]
        assert r.loss_chars == sum(map(len, said)) and r.text.count("<|im_start|>") == r.n_turns


def test_repeated_turns_are_all_rendered(spark, monkeypatch):
    monkeypatch.setattr(chat, "COPIES", 3)
    rows = [(1, None, "ann", "hi"), (1, None, "bob", "hi"), (1, None, "ann", "hi"), (1, None, "bob", "bye")] + [(2, 4, "ann", "hm")] * 8
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.view): r for r in chat.rotate(df).collect()}
    assert {k: (r.n_turns, len(r.loss_spans)) for k, r in got.items()} == {(1, "ann"): (4, 2), (1, "bob"): (4, 2), (2, "ann"): (8, 8)}
    assert plain(chat.rotated(df).collect()) == in_duckdb(chat.ROTATED_SQL, conversations=df)


def test_long_dialogues_go_on_in_shards(spark):
    rows = [(9, i, ("ann", "bob")[i % 2], f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r.view: r for r in chat.rotate(df).collect()}
    parts = {}
    for r in chat.rotate(df, shard_chars=500).orderBy("view", "shard").collect():
        parts.setdefault(r.view, []).append(r)
    for view, shards in parts.items():
        assert len(shards) > 10 and "".join(r.text for r in shards) == whole[view].text
        assert sum(r.loss_chars for r in shards) == whole[view].loss_chars
        assert all(r.text[s.start : s.end].endswith("<|im_end|>") for r in shards for s in r.loss_spans)


# Urls


def test_urls_against_sql(spark):
    rows = [
        (1, "http://a.org/x", '<a href="http://bad.net/es/1">x</a> <a href="//good.com/">'), (2, "http://bad.net/es/2", "<a HREF='https://C.net/q'>"),
        (3, "https://c.net/en/", "nothing"), (4, "http://good.com/", '<a href="http://d.org/"> <a href=/local>'), (5, "http://d.org", None), (6, None, "x"),
        (7, "nohost", ""), (8, "HTTP://WWW.Example.com/en/a?b#c", ""), (9, "http://x.example.com/en/1", ""), (10, "http://e.org/", '<a href="http://bad.net/es/">'),
        (11, "http://notexample.com/en/", ""), (12, "://", ""), (13, "x://y://z/", ""), (14, "http://b.net?/es/", ""), (15, "http://É.NET/fr/é", ""),
        (None, "http://bad.net/fr/", '<a href="http://a.org">'), (1, "http://a.org/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.filtered(clashing(pages))
    assert plain(got.collect()) == in_duckdb(urls.FILTERED_SQL, pages=pages)
    by = {r.page_id: r for r in got.collect()}
    assert (by[8].rule, by[9].rule, by[11].rule, by[14].rule) == ("www.example.com/en/", "example.com/en/", "com/", None)
    assert (by[7].host, by[7].path, by[7].verdict) == ("", "", "allow")
    assert by[10].verdict == "block" and by[5].verdict == "allow" and by[5].trust > 0  # links to a blocked host; linked from a trusted one
    assert urls.filtered(pages.limit(0)).count() == 0


def test_spread_against_power_iteration(spark):
    import numpy as np

    r = np.random.default_rng(1)
    n = 12
    edges = sorted({(int(a), int(b)) for a, b in r.integers(0, n, (40, 2)) if a != b})
    pages = [(i, f"http://h{a}.org/", f'<a href="http://h{b}.org/">') for i, (a, b) in enumerate(edges)]
    pages += [(100, "http://h0.org/", ""), (101, "http://h1.org/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seed_rules = (urls.Rule("allow", "h0.org", "/"), urls.Rule("block", "h1.org", "/"))
    m = np.zeros((n, n))
    for a, b in edges:
        m[a, b] += 1
    forth = np.divide(m, m.sum(1, keepdims=True), where=m.sum(1, keepdims=True) > 0, out=np.zeros_like(m))
    back = np.divide(m, m.sum(0, keepdims=True), where=m.sum(0, keepdims=True) > 0, out=np.zeros_like(m))
    t = d = np.zeros(n)
    t0, d0 = np.eye(n)[0] * 0.15, np.eye(n)[1] * 0.15
    t, d = t0, d0
    for _ in range(urls.ROUNDS):
        t, d = t0 + 0.85 * t @ forth, d0 + 0.85 * back @ d
    got = {x.host: x for x in urls.filtered(df, seed_rules).collect()}
    for i in range(n):
        if f"h{i}.org" in got:
            assert got[f"h{i}.org"].trust == pytest.approx(t[i], abs=1e-8) and got[f"h{i}.org"].distrust == pytest.approx(d[i], abs=1e-8)


# Pipeline and registry


def test_stages_keep_columns_and_clean_documents(spark):
    docs = clashing(table(spark, MIDDLE, "documents")).unionByName(
        clashing(documents(spark, [None, "", "123 456", "Anly the same text here of and"], first=90_000)).union(
            clashing(documents(spark, ["Anly the same text here of and"], first=90_003))
        )
    )
    columns, now = docs.columns, docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, MIDDLE), "test")
        assert now.columns == columns and now.where("score <> 'x'").count() == 0
        sizes.append(now.count())
    assert sizes[0] == docs.count() - 3 and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert now.groupBy("doc_id").count().where("count > 1").count() == 0
    assert now.where("n_chars <> length(text)").count() == 0
    toxic = {r.doc_id for r in table(spark, MIDDLE, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, MIDDLE, "labels").where("toxic = 0").collect()}
    left = {r.doc_id for r in now.collect()}
    assert len(left & clean) > 0.8 * len(clean) and not left >= toxic
    packed = corpus_pipeline.STAGES[-1][1](spark, now, MIDDLE)
    assert {r.doc_id for r in packed.collect()} == left


def test_empty_documents_go_through(spark):
    now = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        assert now.count() == 0


def test_registered():
    queries, sql = driver.queries(), driver.oracle_sql()
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries if re.match(r"op\d+_", q))
    assert numbers == list(range(1, 14)) and "pipeline" in queries
    assert {q for q in sql if q.startswith("op")} == {"op1_link_propagation", "op2_perspective_rotation", "op7_rule_ledger", "op12_trie_pairs", "op13_drift_clusters"}
