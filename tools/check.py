"""Run registered queries in Spark and their SQL in DuckDB, and compare row by row.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)

from lanefold import plans  # noqa: E402
from lanefold.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    queries, oracles = plans.registered(), plans.oracles()
    bad = []
    for name in args.names or list(queries):
        t0 = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = df.collect()
        except Exception as exc:
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - t0
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.2f}s {df.columns}", flush=True)
            continue
        t0 = time.time()
        try:
            cur = duck.execute(oracles[name])
            want_names = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as exc:
            print(f"SQL  {name}: {str(exc)[:1500]}", flush=True)
            bad.append(name)
            continue
        sql_took = time.time() - t0
        a, b = rows_of(df.columns, got), rows_of(want_names, want)
        want_types = {d[0]: str(d[1]) for d in cur.description}
        odd = [(c, t, want_types.get(c)) for c, t in df.dtypes if KINDS.get(t) != want_types.get(c)]
        if odd:
            print(f"TYPE {name}: {odd}", flush=True)
            bad.append(name)
        if sorted(df.columns) != sorted(want_names):
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(want_names)}", flush=True)
            bad.append(name)
        elif a != b:
            only_a = [r for r in a if r not in set(b)][:3]
            only_b = [r for r in b if r not in set(a)][:3]
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows\n  spark {only_a}\n  sql   {only_b}", flush=True)
            bad.append(name)
        else:
            kinds = {str(d[1]) for d in cur.description}
            print(f"ok   {name}: {len(a)} rows {took:.2f}s (sql {sql_took:.2f}s) {sorted(kinds)}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
