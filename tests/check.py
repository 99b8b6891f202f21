"""Compare registered queries with their SQL checks: `python tests/check.py [sf_dir] [prefix ...]`."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(path: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(path)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{path}/{name}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return ("f", value + 0.0)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        repr(tuple(cell(r[i]) for i in order)) for r in data
    )


def compare(spark, con, path, job, sql):
    """(number of rows, problem text or None)."""
    begin = time.time()
    df = job(spark, path)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    print(f"     {time.time() - begin:.1f}s on Spark", end=" ")
    if sql is None:
        return len(got), None if got else "no rows"
    result = con.execute(sql)
    want_cols, want = rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return len(got), f"{len(got)} vs {len(want)} rows; spark {extra[:3]} sql {missing[:3]}"
    return len(got), None if got else "no rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from domainlake.session import local_session

    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    if os.environ.get("PLAIN"):  # a session without any of our settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(path), oracle_sql(), 0
    for name, job in queries().items():
        if not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            n, problem = compare(spark, con, path, job, checks.get(name))
        except Exception as error:  # report and go on with the next query
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {n} {time.time() - begin:.1f}s {problem or ''}")
    print("failures:", bad)
