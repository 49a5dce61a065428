"""Time the DuckDB oracle statements (the reference engine running the
reference's statements through the adapter) on one scale factor.

Usage: python tools/duckdb_timing.py [SF_DIR]   -> one JSON line
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from oracle_sql import oracle_sql  # noqa: E402
from tools.oracle_check import TABLES  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = {}
    for k, sql in oracle_sql().items():
        samples = []
        for i in range(4):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            if i:
                samples.append(time.perf_counter() - t0)
        out[k] = round(statistics.median(samples), 4)
    print(json.dumps({"engine": "duckdb " + duckdb.__version__, "sf_dir": sf_dir,
                      "value": round(sum(out.values()), 3), "queries": out}))


if __name__ == "__main__":
    main()
