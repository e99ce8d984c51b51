"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

Usage: python -m tests.compare [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "asDict"):
        return _norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return sorted((str(k), str(_norm(x))) for k, x in v.items())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return str(v.replace(tzinfo=None))
    return str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([str(_norm(r[i])) for i in order] for r in rows)


def compare(spark, con, sf: str, fn, sql: str) -> str:
    df = fn(spark, sf)
    cols_s, rows_s = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols_d, rows_d = _table([d[0] for d in cur.description], cur.fetchall())
    if cols_s != cols_d:
        return f"columns differ: spark {cols_s} / sql {cols_d}"
    if not rows_s:
        return "no rows"
    if len(rows_s) != len(rows_d):
        return f"rows differ: spark {len(rows_s)} / sql {len(rows_d)}"
    bad = [(a, b) for a, b in zip(rows_s, rows_d) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows_s)} rows differ; {cols_s}\n    spark {bad[0][0]}\n    sql   {bad[0][1]}"
    return "ok"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from txflow.session import get_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, sf, fn, oracles[name])
            else:
                result = f"ok (rows only: {fn(spark, sf).count()})"
        except Exception as e:  # report and go on to the next query
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        if not result.startswith("ok"):
            bad += 1
        print(f"{name:36s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
