"""Run every registered query and its SQL twin, and compare names, types and values.

    python tools/compare.py [--sf DIR] [--match TEXT] [--seconds]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
entry = importlib.import_module("__spark_entry__")
from rillwork.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def key(row):
    return tuple("~" if v is None else (f"{v:.10g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--match", default="")
    a = ap.parse_args()
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{a.sf}/{t}.parquet'")
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if not any(m in name for m in a.match.split(",")):
            continue
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            cols = sorted(df.columns)
            rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows  {name}: {len(rows)} rows  {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sql[name])
            names = [d[0] for d in cur.description]
            got = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t2 = time.time()
        if sorted(names) != cols:
            print(f"COLS  {name}: spark {cols} sql {sorted(names)}")
            bad.append(name)
            continue
        order = [names.index(c) for c in cols]
        got = sorted((tuple(r[i] for i in order) for r in got), key=key)
        rows = sorted(rows, key=key)
        diff = [(x, y) for x, y in zip(rows, got) if not all(same(p, q) for p, q in zip(x, y))]
        if len(rows) != len(got) or diff:
            print(f"DIFF  {name}: {len(rows)} vs {len(got)} rows, {len(diff)} differ")
            print("      ", cols)
            for x, y in diff[:3]:
                print("       spark", x)
                print("       sql  ", y)
            bad.append(name)
        else:
            print(f"ok    {name}: {len(rows)} rows  spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
