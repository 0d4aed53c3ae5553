"""Run registered queries and their SQL counterparts side by side and compare the results.

Usage: python tests/oracle_check.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf_dir) -> tuple[str, float, float]:
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    if sql is None:
        return f"rows only: {len(got)}", spark_seconds, 0.0
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    duck_seconds = time.time() - start
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(names, want)
    if ca != cb:
        return f"COLUMNS {sorted(set(ca) ^ set(cb))}", spark_seconds, duck_seconds
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", spark_seconds, duck_seconds
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            bad = [(c, p, q) for c, p, q in zip(ca, x, y) if p != q or type(p) is not type(q)]
            return f"VALUES {bad[:4]} in {x[:6]}", spark_seconds, duck_seconds
    return f"ok {len(a)}", spark_seconds, duck_seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from celltide.runtime import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    con, failures = connect(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        try:
            verdict, s, d = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict, s, d = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
        failures += not verdict.startswith(("ok", "rows only"))
        print(f"{name:24s} {s:6.2f}s {d:6.2f}s  {verdict}", flush=True)
    print("failures:", failures)
