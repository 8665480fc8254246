"""Run queries and their SQL side by side: ``python -m linegrain.checks.compare [folder] [name …]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from linegrain.plans import QUERIES_AND_ORACLES
from linegrain.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or isinstance(v, str | bool):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, int):
        return f"{v}"
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    queries, oracles = QUERIES_AND_ORACLES()
    start = time.time()
    df = queries[name](spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in oracles:
        return True, f"{spent:6.2f}s  rows only: {len(got[1])}"
    start = time.time()
    cur = con.execute(oracles[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    spent_sql = time.time() - start
    note = f"{spent:6.2f}s  duckdb {spent_sql:6.2f}s  rows {len(got[1])}"
    if got[0] != want[0]:
        return False, f"{note}  columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        only = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
        return False, f"{note} vs {len(want[1])}\n   spark only {only[0]}\n   sql only {only[1]}"
    return True, note


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, _ = QUERIES_AND_ORACLES()
    names = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = build_session("linegrain-compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as exc:  # report and go on to the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} ok; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
