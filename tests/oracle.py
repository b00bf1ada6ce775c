"""Runs registered queries next to their reference SQL and compares whole results.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from auctionlake.plans.views import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) if not isinstance(v, int) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, run, sql, sf_dir):
    """'' when equal, else what differs."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} <> {len(want[1])}"
    kinds = dict(r[:2] for r in con.execute(f"describe {sql}").fetchall())
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b and repr(a) != repr(b)]
    bad = [(a, b) for a, b in bad if not all(x == y for x, y in zip(a, b))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("auctionlake-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def main():
    from auctionlake.plans.catalog import CATALOG

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(CATALOG)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for n in names:
        run, sql = CATALOG[n]
        t = time.time()
        try:
            if sql:
                diff = compare(spark, con, run, sql, sf_dir)
                size = con.execute(f"select count(*) from ({sql})").fetchall()[0][0]
            else:
                diff, size = "", run(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            diff, size = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {n:34s} rows={size:<8} {time.time() - t:5.1f}s {'' if sql else '(rows only)'} {diff}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main()
