"""Compare registered queries with their DuckDB twins.

usage: python tools/check.py [key-or-module ...]   (env SF_DIR, CPUS)
"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.catalog import load_all  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(df, ints=()):
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_float_dtype(s) and c not in ints:
            out[c] = s.map(lambda x: "NULL" if pd.isna(x) else f"{x + 0.0:.6f}")
        else:
            out[c] = s.map(lambda x: "NULL" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x))
                           or x is pd.NA else str(int(x)) if isinstance(x, (float, np.integer)) else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def main(args):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(f"local[{os.environ.get('CPUS', '8')}]", 8, "12g")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = []
    for key, q in load_all().items():
        if args and key not in args and q.build.__module__.split(".")[-1] not in args:
            continue
        t0 = time.time()
        try:
            got = q.run(spark, sf)
            types = dict(got.dtypes)
            got = got.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{key:34s} SPARK ERROR {str(e)[:500]}", flush=True)
            bad.append(key)
            continue
        t1 = time.time()
        sql = q.oracle()
        if sql is None:
            print(f"{key:34s} rows={len(got):6d} {t1-t0:5.1f}s  (rows only)", flush=True)
            if len(got) == 0:
                bad.append(key)
            continue
        try:
            want = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"{key:34s} SQL ERROR {str(e)[:500]}", flush=True)
            bad.append(key)
            continue
        ints = {c for c, t in types.items() if t == "bigint"}
        a, b = _norm(got, ints), _norm(want, ints)
        ok = list(a.columns) == list(b.columns) and a.equals(b)
        note = "" if len(a) else "  EMPTY"
        print(f"{key:34s} rows={len(a):6d} {t1-t0:5.1f}s duck={time.time()-t1:5.1f}s {'ok' if ok else 'MISMATCH'}{note}",
              flush=True)
        if not ok or not len(a):
            bad.append(key)
        if not ok:
            print("   spark", len(a), "duck", len(b), types)
            m = a.merge(b, how="outer", indicator=True)
            m = m[m["_merge"] != "both"]
            print(m.head(6).to_string(max_colwidth=60))
    print("BAD:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
