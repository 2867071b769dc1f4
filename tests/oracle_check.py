"""Run registered queries against the oracle engine: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


def normal(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else f"{v + 0.0:.12g}"
    if isinstance(v, int):
        return f"{float(v):.12g}" if abs(v) < 2**53 else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return f"{float(v):.12g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{normal(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir, con):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns differ: spark {sorted(df.columns)} oracle {sorted(cols)}"
    if got == want:
        return len(got), ""
    if len(got) != len(want):
        return len(got), f"rows differ: spark {len(got)} oracle {len(want)}; spark-only {next((g for g in got if g not in set(want)), None)} oracle-only {next((w for w in want if w not in set(got)), None)}"
    g, w = next((g, w) for g, w in zip(got, want) if g != w)
    names = sorted(cols)
    diff = [(n, a, b) for n, a, b in zip(names, g, w) if a != b][:6]
    bad = sum(1 for a, b in zip(got, want) if a != b)
    return len(got), f"{bad} of {len(got)} rows differ, first: {diff} in {g[:4]}"


def oracle_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def main():
    import __spark_entry__ as entry
    from fluxloom.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    picked = args[1:]
    spark = local_session("oracle-check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, name, fn, oracles.get(name), sf_dir, con)
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        word = "rows-only" if problem is None else "ok" if problem == "" else "FAIL " + problem
        bad += bool(problem)
        print(f"{name:34s} {n:8d} rows {time.time() - t:6.2f}s  {word}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
