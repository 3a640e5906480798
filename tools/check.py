"""Run registered queries beside their SQL on one data folder and compare all rows.

    python tools/check.py /root/testdata/sf0.01 [name ...]

VERBOSE=1 prints every query. HOT_ROWS=20 makes nearly every group a hot one, and BROADCAST=-1
turns off broadcast joins by size, to see the plans of large data give the same rows.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trialspark.plans import catalog, ordered  # noqa: E402
from trialspark.session import build  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, Decimal):
        return ("d", str(value.normalize()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    start = time.time()
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    took = time.time() - start
    names, mine = rows_of(df.columns, got)
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return f"rows {len(got)}", took
    cur = con.execute(sql)
    types = [str(d[1]) for d in cur.description]
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"COLUMNS {names} <> {want_names}", took
    if mine != want:
        left, right = list((mine - want).items())[:3], list((want - mine).items())[:3]
        return f"DIFFER {len(got)} rows, spark only {sum((mine - want).values())} {left}, sql only {right}", took
    odd = [t for t in types if "HUGEINT" in t or "DECIMAL" in t]
    return f"ok {len(got)} rows" + (f" TYPES {odd}" if odd else ""), took


def main():
    sf, only = sys.argv[1], sys.argv[2:]
    if os.environ.get("HOT_ROWS"):
        ordered.HOT_ROWS = int(os.environ["HOT_ROWS"])
    spark = build("check", "local[8]", **{
        "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BROADCAST", "10485760"),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": os.environ.get("BROADCAST", "10485760"),
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                          "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in only or catalog.QUERIES:
        try:
            said, took = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            said, took = f"FAILED {type(e).__name__}: {str(e)[:600]}", 0
        good = said.startswith(("ok", "rows"))
        bad += not good
        if not good or os.environ.get("VERBOSE") or "TYPES" in said:
            print(f"{name:22} {took:6.2f}s {said[:1200]}", flush=True)
    print(f"{len(only or catalog.QUERIES)} queries, {bad} not matching")
    return bad > 0


if __name__ == "__main__":
    sys.exit(main())
