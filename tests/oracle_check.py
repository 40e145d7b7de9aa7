"""Run registered Spark queries next to their DuckDB twins and compare results.

Comparison: same column names, same row count, same multiset of rows (order-insensitive;
doubles compared after rounding to 9 significant digits). Usable from pytest and as a
script: ``python tests/oracle_check.py /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def compare(spark, name: str, query, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = df.columns
    rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    t1 = time.time()
    out = {"name": name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    out["duck_rows"] = len(drows)
    if sorted(cols) != sorted(dcols):
        out["status"] = f"columns differ: {cols} vs {dcols}"
        return out
    stypes = dict(df.dtypes)
    dtypes = {d[0]: str(d[1]).upper() for d in res.description}
    bad_types = {c: (stypes[c], dtypes[c]) for c in cols
                 if SPARK_TO_DUCK.get(stypes[c], stypes[c].upper()) != dtypes[c]}
    if bad_types:
        out["types"] = bad_types
    perm = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in perm) for r in drows]
    a, b = sorted(rows, key=_key), sorted(drows, key=_key)
    if a == b:
        out["status"] = "match" if not bad_types else "match (types differ)"
    else:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["status"] = f"values differ: spark-only {diff_a} duck-only {diff_b}"
    return out


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from visitlens.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sqls.get(n), sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "rows-only")
        if "types" in r:
            bad += 1
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
