"""Runs registered queries in Spark and DuckDB and compares the sorted rows exactly."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(v)


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


#: Reports of what is wrong, which is nothing in the supplied tables.
MAY_BE_EMPTY = {"scan_errors", "analyze_errors"}


def compare(spark, con, sf_dir, name, fn, sql) -> tuple[bool, str]:
    """An empty result counts as a failure: it would agree with any SQL."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    took = time.time() - start
    if not got and name not in MAY_BE_EMPTY:
        return False, "no rows"
    if sql is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    duck_took = time.time() - start
    note = f"{len(got)} rows vs {len(want)}, spark {took:.1f}s duckdb {duck_took:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    if got != want:
        bad = next(((g, w) for g, w in zip(got, want) if g != w), None)
        cols = sorted(names)
        if bad:
            bad = [(c, g, w) for c, g, w in zip(cols, *bad) if g != w]
        return False, f"{note}; first difference {bad}"
    return True, note


def session(cpus: str = "8", partitions: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
