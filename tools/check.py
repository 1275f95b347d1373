"""Run the catalog's queries against their check SQL in DuckDB: python tools/check.py [sf] [name…]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from provenir import catalog  # noqa: E402
from provenir.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "sf0.01"
    folder = f"/root/testdata/{sf}"
    catalog.load()
    names = argv[1:] or list(catalog.QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            got = df.collect()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark: {str(error)[:1500]}")
            continue
        took = time.time() - start
        if name not in catalog.ORACLES:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s")
            continue
        start = time.time()
        try:
            res = con.execute(catalog.ORACLES[name])
            want_columns = [d[0] for d in res.description]
            want = res.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb: {str(error)[:1500]}")
            continue
        took_sql = time.time() - start
        a, b = rows_of(df.columns, got), rows_of(want_columns, want)
        if sorted(df.columns) != sorted(want_columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(want_columns)}")
        elif a != b:
            bad += 1
            print(f"FAIL {name}: {len(a)} rows vs {len(b)}; columns {sorted(df.columns)}")
            sa, sb = set(a), set(b)
            for row in sorted(sa - sb)[:3]:
                print("   spark ", str(row)[:600])
            for row in sorted(sb - sa)[:3]:
                print("   duckdb", str(row)[:600])
        else:
            print(f"ok   {name}: {len(a)} rows, spark {took:.1f}s, duckdb {took_sql:.1f}s")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
