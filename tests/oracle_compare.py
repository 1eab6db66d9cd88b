"""Run queries() and oracle_sql() side by side (row count, column names and an
order-insensitive value comparison), the way the driver's correctness gate does.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            stypes = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                      for f in df.schema.fields}
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", str(e)[:400])
            print(name, "SPARK-ERROR", str(e)[:2000], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            print(f"{name}: rows-only {len(srows)} rows ({ts:.1f}s)", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL-ERROR", str(e)[:400])
            print(name, "SQL-ERROR", str(e)[:2000], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols) and stypes == dtypes
        a, b = _rows(scols, srows), _rows(dcols, drows)
        ok = ok_cols and a == b
        results[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} ({ts:.1f}s)", flush=True)
        if not ok and verbose:
            if not ok_cols:
                print("  schema spark", sorted(stypes.items()), "duck", sorted(dtypes.items()))
            else:
                sa, sb = set(a), set(b)
                print("  spark-only", list(sa - sb)[:3])
                print("  duck-only ", list(sb - sa)[:3])
    return results


if __name__ == "__main__":
    from corpusflow.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("FAILED:", bad)
