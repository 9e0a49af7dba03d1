"""Run registered queries against their oracles: python -m verification.check [--sf DIR] [name ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditlake.session import build_session  # noqa: E402
from verification.catalog import oracles, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in records)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    sql, bad = oracles(), []
    for name, query in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = query(spark, args.sf)
            got = _rows([tuple(r) for r in df.collect()], df.columns)
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            cursor = con.execute(sql[name])
            names = [d[0] for d in cursor.description]
            want = _rows(cursor.fetchall(), names)
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name} (oracle): {str(error)[:600]}", flush=True)
            continue
        if sorted(names) != sorted(df.columns):
            bad.append(name)
            print(f"FAIL {name}: columns {sorted(df.columns)} != {sorted(names)}", flush=True)
        elif got != want:
            bad.append(name)
            only = [r for r in got if r not in set(want)][:2]
            other = [r for r in want if r not in set(got)][:2]
            print(f"FAIL {name}: {len(got)} rows vs {len(want)}\n  spark {only}\n  sql   {other}", flush=True)
        else:
            print(f"ok   {name}: {len(got)} rows, {took:.1f}s{'  EMPTY' if not got else ''}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
