"""Run registered queries and their SQL side by side: check.py [sf] [name ...]."""

import math
import os
import sys
import time

import duckdb

from ridgeline.catalog import ORACLES, QUERIES
from ridgeline.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    """(rows, difference or None) of one query against its SQL."""
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.collect(), df.columns)
    if name not in ORACLES:
        return len(got), None
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {df.columns} vs {names}"
    if got == want:
        return len(got), None
    only_got = [r for r in got if r not in set(want)]
    only_want = [r for r in want if r not in set(got)]
    return len(got), (f"{len(got)} vs {len(want)} rows; {len(only_got)}/{len(only_want)} differ "
                      f"{sorted(names)} {only_got[:3]} {only_want[:3]}")


if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            rows, diff = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            rows, diff = -1, f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - start
        state = "FAIL" if diff or rows == 0 else ("ok" if name in ORACLES else "rows only")
        bad += state == "FAIL"
        print(f"{state:9} {name:28} {rows:8} {took:6.1f}s {diff or ''}", flush=True)
    print("failed:", bad)
