"""Compare queries with their SQL: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con


def plain(x):
    if isinstance(x, bool):
        return x
    if hasattr(x, "as_tuple") or isinstance(x, float):
        x = float(x)
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    return x


def key(row: tuple) -> tuple:
    return tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in (round(v, 4) if isinstance(v, float) else v for v in row))


def difference(got, con, sql: str) -> str:
    """What differs between a DataFrame and the SQL's rows; empty if nothing does."""
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    if len(rows) != len(want):
        return f"{len(rows)} rows for {len(want)}"
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y))):
                return f"{a} for {b}"
    exact = sum(a != b for a, b in zip(rows, want))
    return f"(close, {exact} of {len(rows)} rows not exact)" if exact else ""


def main(sf_dir: str, *names: str) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, queries = connect(sf_dir), e.oracle_sql(), e.queries()
    for name in names or queries:
        began = time.time()
        try:
            if name in sqls:
                said = difference(queries[name](spark, sf_dir), con, sqls[name]) or "same"
            else:
                said = f"{queries[name](spark, sf_dir).count()} rows"
        except Exception as x:  # noqa: BLE001, all are wanted in the list
            said = f"ERROR {type(x).__name__} {str(x)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
