"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return repr([norm(x) for x in v])
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(con, spark, sf_dir, fn, sql):
    """(ok, message)"""
    df = fn(spark, sf_dir)
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return True, f"{len(got)} rows (spark {took:.1f}s)"


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from partwise.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark, con = local_session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, text = compare(con, spark, sf_dir, fn, sqls[name])
            else:
                rows = fn(spark, sf_dir).collect()
                ok, text = len(rows) > 0, f"{len(rows)} rows, no SQL; first {rows[:1]}"
        except Exception as error:
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", text, flush=True)
