"""Run queries in Spark and their SQL in DuckDB, compare names, row counts and values.

``python -m tests.oracle_check [sf_dir] [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def value(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) or x.__class__.__name__ == "Decimal":
        return repr(float(x))
    if isinstance(x, int):
        return repr(float(x))
    return str(x)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def difference(spark, con, sf_dir, name):
    """None when both engines agree, else a short description."""
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} / {len(want[1])} rows, extra {list(extra)[:2]}, missing {list(missing)[:2]}"
    return None


if __name__ == "__main__":
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(sf_dir)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            result = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:24} {time.time() - start:6.2f}s {'ok' if result is None else 'DIFF ' + result}", flush=True)
