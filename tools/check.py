"""Run registered queries against their SQL twins.  python tools/check.py [--sf 0.01] [name-prefix ...]"""
import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidemark import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, list):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("prefix", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--slow", type=float, default=4.0)
    ap.add_argument("--verbose", action="store_true")
    a = ap.parse_args()
    d = f"/root/testdata/sf{a.sf}"
    reg = catalog.load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = []
    for name, e in reg.items():
        if a.prefix and not any(name.startswith(p) for p in a.prefix):
            continue
        t0 = time.time()
        try:
            df = e.fn(spark, d)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:
            bad.append(name)
            print(f"ERROR spark {name}: {str(ex)[:700]}", flush=True)
            if a.verbose:
                traceback.print_exc()
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"rows  {name:34s} {len(rows):7d} rows  {ts:5.1f}s", flush=True)
            continue
        t0 = time.time()
        try:
            res = con.execute(e.sql)
            ocols = [c[0] for c in res.description]
            orows = res.fetchall()
        except Exception as ex:
            bad.append(name)
            print(f"ERROR duckdb {name}: {str(ex)[:600]}", flush=True)
            continue
        to = time.time() - t0
        if sorted(cols) != sorted(ocols):
            bad.append(name)
            print(f"COLS  {name}: only spark {sorted(set(cols) - set(ocols))}; only sql {sorted(set(ocols) - set(cols))}", flush=True)
            continue
        order = sorted(cols)
        A = sorted([tuple(norm(r[cols.index(c)]) for c in order) for r in rows])
        B = sorted([tuple(norm(r[ocols.index(c)]) for c in order) for r in orows])
        if A == B:
            print(f"ok    {name:34s} {len(rows):7d} rows  {ts:5.1f}s  duckdb {to:4.1f}s{'  SLOW' if ts > a.slow else ''}{'  EMPTY' if not rows else ''}", flush=True)
        else:
            bad.append(name)
            print(f"DIFF  {name}: {len(A)} vs {len(B)} rows", flush=True)
            sa, sb = set(A), set(B)
            for r in sorted(sa - sb)[:3]:
                print("   spark", dict(zip(order, r)))
            for r in sorted(sb - sa)[:3]:
                print("   sql  ", dict(zip(order, r)))
    print("FAILED:" if bad else "all good", bad)


if __name__ == "__main__":
    main()
