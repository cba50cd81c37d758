"""Compare registered queries with their SQL: python -m tests.check [sf_dir] [names...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb

import __spark_entry__ as entry
from catalogspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str):
    """-> (ok, detail) for one query; ok is None where there is no SQL."""
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, f"{len(got)} rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} vs {len(want)} rows; only ours {extra}; only SQL {missing}"
    return True, f"{len(got)} rows"


def main(argv) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    if argv[1:2] == ["--sql"]:
        names = [n for n in entry.oracle_sql()]
    folder = tempfile.mkdtemp(prefix="queries-")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{"spark.checkpoint.dir": folder})
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, detail = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, detail = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += ok is False
        label = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        print(f"{label} {name:34s} {time.time() - start:6.1f}s  {detail}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
