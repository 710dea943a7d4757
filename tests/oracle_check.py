"""Run registered queries beside their SQL and compare whole results.

    python tests/oracle_check.py [sf] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    left = sorted(tuple(_plain(x) for x in r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    types = {c: t for c, t in df.dtypes}
    return f"{len(bad)} of {len(left)} differ, e.g. {cols} {bad[0]} {types}" if bad else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from skewlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    known, oracles = queries(), oracle_sql()
    wanted = sys.argv[2:] or list(known)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = known[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFFERS: {problem}"
            else:
                state = f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            state = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += state.startswith(("DIFFERS", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {state}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
