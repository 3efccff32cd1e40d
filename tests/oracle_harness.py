"""Run registered queries against their DuckDB oracle SQL (the driver's gate, locally).

Usage: python tests/oracle_harness.py [sf_dir] [--shuffle-partitions N] [name ...]

``--shuffle-partitions 2000`` runs the suite with a cluster's partition count
(block counts, split points and AQE paths then take their large-scale form).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.perf_counter()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.perf_counter()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(s_rows), "sec": t1 - t0}
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res = {"name": name, "rows": (len(s_rows), len(d_rows)), "sec": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={s_cols} duck={d_cols}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "ok"
    else:
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        res["status"] = f"VALUES spark-only={only_a} duck-only={only_b}"
    return res


def main(argv):
    from washframe.plans.catalog import ORACLE, QUERIES
    from washframe.session import build_session
    args = list(argv[1:])
    partitions = None
    if "--shuffle-partitions" in args:
        at = args.index("--shuffle-partitions")
        partitions = int(args[at + 1])
        del args[at:at + 2]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session(shuffle_partitions=partitions)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
