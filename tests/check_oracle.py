"""Compare registered queries with their SQL twins: python tests/check_oracle.py SF_DIR [name ...]"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, pair):
    """None when equal, else a description of the difference."""
    fn, sql = pair
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if not sql:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {sorted(names)} != {cols}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in cur.fetchall()]
    key = lambda row: tuple((x is None, str(type(x)), str(x)) for x in row)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"rows {len(got)} vs {len(want)} on {cols}; first differences {str(bad)[:900]}"
    return None if want else "no rows"


if __name__ == "__main__":
    from vacantia.plans.catalog import catalog
    from vacantia.session import build_session

    sf, only = sys.argv[1], set(sys.argv[2:])
    spark = build_session("check", "local[8]", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, pair in catalog().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, sf, name, pair)
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += diff is not None
        print(f"{name:26s} {time.time() - start:6.1f}s  {'ok' if diff is None else diff}", flush=True)
    print("differences:", bad)
