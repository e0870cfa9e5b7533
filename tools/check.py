"""Run registered queries against their DuckDB oracle: ``python tools/check.py [sf] [name-part ...]``."""

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from cairn.plans import load_all
from cairn.plans.registry import ORACLE, QUERIES
from cairn.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 1 << 52 else str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(canon(r[i]) for i in order) for r in rows)


def main(argv):
    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", 8)
    load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in ORACLE:
                print(f"--   {name:45s} rows={len(got)} {t1 - t0:.2f}s (no oracle)", flush=True)
                continue
            cur = con.execute(ORACLE[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
            ok = got_cols == want_cols and got == want
            print(f"{'ok' if ok else 'BAD':4s} {name:45s} rows={len(got)}/{len(want)} {t1 - t0:.2f}s duck {t2 - t1:.2f}s", flush=True)
            if not ok:
                bad.append(name)
                if got_cols != want_cols:
                    print("   columns", got_cols, want_cols)
                g, w = set(got), set(want)
                print("   only spark:", [x[:300] for x in list(sorted(g - w))[:3]])
                print("   only duck :", [x[:300] for x in list(sorted(w - g))[:3]])
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            bad.append(name)
            print(f"ERR  {name}: {str(exc)[:1200]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
