"""Compare registered queries with their SQL on the given tables.

    python check.py [folder] [setting=value ...] [key prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback

import duckdb

from millrace.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, type(v).__name__, v if v is not None else 0) for v in r])


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    """An empty text when both results hold the same rows."""
    got_names = df.columns
    found = con.execute(sql)
    want_names = [d[0] for d in found.description]
    want = found.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} but SQL has {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows but SQL has {len(want)}"
    names = sorted(got_names)
    gi, wi = [got_names.index(n) for n in names], [want_names.index(n) for n in names]
    a = ordered([tuple(plain(r[i]) for i in gi) for r in got])
    b = ordered([tuple(plain(r[i]) for i in wi) for r in want])
    for x, y in zip(a, b):
        for n, p, q in zip(names, x, y):
            if p != q or type(p) is not type(q):
                return f"{n}: {p!r} but SQL has {q!r}; rows {x} / {y}"
    return ""


def main() -> int:
    from millrace.queries import ORACLES, QUERIES

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    while args and "=" in args[0]:
        spark.conf.set(*args.pop(0).split("=", 1))
    con = connect(folder)
    bad = 0
    for key, run in QUERIES.items():
        if args and not any(key.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            problem = compare(df, con, ORACLES[key]) if key in ORACLES else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = "FAILED " + "".join(traceback.format_exception_only(e))[:600]
        taken = time.time() - start
        wrong = bool(problem) and not problem.startswith("rows only")
        bad += wrong
        if problem or taken > 5:
            print(f"{'BAD ' if wrong else 'ok  '}{key} {taken:.1f}s {problem[:700]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
