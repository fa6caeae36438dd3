"""Runs registered queries against their SQL in DuckDB and compares rows, names, types and values.

Usage: python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def compare(df, con, sql: str) -> str:
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    have_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if set(want_types) != set(have_types):
        return f"columns differ: spark {sorted(have_types)} sql {sorted(want_types)}"
    names = sorted(have_types)
    types = [f"{n}: {have_types[n]} vs {want_types[n]}" for n in names if have_types[n] != want_types[n]]
    have = sorted(tuple(cell(r[n]) for n in names) for r in df.select(*names).collect())
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    note = f" TYPES {types}" if types else ""
    if len(have) != len(want):
        return f"rows differ: spark {len(have)} sql {len(want)}{note}\n  {have[:2]}\n  {want[:2]}"
    off = [(h, w) for h, w in zip(have, want) if h != w]
    if off:
        return f"{len(off)} of {len(have)} rows differ{note}, first:\n   {off[0][0]}\n   {off[0][1]}"
    return f"ok {len(have)} rows{note}" if not types else f"{len(have)} rows equal but{note}"


def main() -> None:
    import __spark_entry__ as entry

    from fieldcheck.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                verdict = f"rows only: {len(rows)} {[str(r)[:160] for r in rows[:2]]}"
        except Exception as e:  # report and go on with the next query
            verdict = f"FAILED {type(e).__name__}: {str(e)[:700]}"
        good = verdict.startswith("ok") or verdict.startswith("rows only")
        if not good:
            bad.append(name)
        print(f"{time.time() - t:6.1f}s {name}: {verdict}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
