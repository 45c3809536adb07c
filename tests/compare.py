"""Run registered queries in Spark and DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v).__name__ if v is not None else ""), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both give the same columns, types and rows."""
    relation = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} != {sorted(relation.columns)}"
    ours = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=_key)
    theirs = sorted(relation.select(*names).fetchall() if len(names) > 1 else [(r[0],) for r in relation.select(names[0]).fetchall()], key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wide = [n for n, kind in zip(relation.columns, relation.types) if str(kind) in ("HUGEINT",) or "DECIMAL" in str(kind)]
    if wide:
        return f"SQL types of {wide}"
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(_same(x, y) for x, y in zip(a, b))]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if not _same(x, y)]
        return f"{len(bad)} of {len(ours)} rows differ, first: {cells[:5]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = build(session, sf_dir)
            message = difference(df, connection, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            message = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(message) and not message.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s {message or 'ok'}", flush=True)
    print("failed:", failed)
