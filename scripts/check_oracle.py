"""Run registered queries on Spark and their oracle SQL on DuckDB, and compare.

usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabflow.plans.registry import load_all  # noqa: E402
from tabflow.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
            "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def close(a, b):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u == v:
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and not isinstance(u, bool):
                if abs(u - v) <= 1e-6 * max(1.0, abs(u), abs(v)):
                    continue
            return False
    return True


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, oracle = load_all()
    n_ok = n_bad = 0
    for name, fn in queries.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            n_bad += 1
            print(f"ERROR-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        sql = oracle.get(name)
        if sql is None:
            print(f"ROWS-ONLY {name}: spark_rows={len(srows)} cols={sorted(scols)} {ts:.1f}s")
            n_ok += 1
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            n_bad += 1
            print(f"ERROR-DUCK {name}: {str(e)[:400]}")
            continue
        if sorted(scols) != sorted(dcols):
            n_bad += 1
            print(f"COLS {name}: spark={sorted(scols)} duck={sorted(dcols)}")
            continue
        dtypes = {d[0]: str(d[1]) for d in res.description}
        bad_types = []
        for f in sdf.schema.fields:
            want = TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
            got = dtypes.get(f.name, "?").upper()
            if want.upper() != got and not (want == "DECIMAL" and got.startswith("DECIMAL")):
                bad_types.append(f"{f.name}:{f.dataType.simpleString()}/{got}")
        if bad_types:
            print(f"TYPES {name}: {bad_types}")
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        exact = a == b
        if exact or close(a, b):
            n_ok += 1
            print(f"OK{'' if exact else '~'} {name}: rows={len(a)} {ts:.1f}s")
        else:
            n_bad += 1
            print(f"MISMATCH {name}: spark_rows={len(a)} duck_rows={len(b)}")
            from collections import Counter
            ca, cb = Counter(a), Counter(b)
            diff_a = list((ca - cb).elements())[:3]
            diff_b = list((cb - ca).elements())[:3]
            print(f"   cols={sorted(scols)}\n   spark-only={diff_a}\n   duck-only={diff_b}")
    print(f"TOTAL ok={n_ok} bad={n_bad}")


if __name__ == "__main__":
    main()
