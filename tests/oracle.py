"""Compare registered queries with their SQL on DuckDB: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"{type(value).__name__ if isinstance(value, bool) else ''}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, folder):
    """(ok, message)."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine != theirs:
        extra = [m for m in mine if m not in set(theirs)][:3]
        missing = [m for m in theirs if m not in set(mine)][:3]
        return False, f"{len(mine)} vs {len(theirs)} rows {sorted(names)}\n   spark {extra}\n   sql   {missing}"
    return True, f"{len(mine)} rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[1:]
    bad = []
    for name, query in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in e.oracle_sql():
                ok, message = compare(spark, con, name, query, e.oracle_sql()[name], folder)
            else:
                rows = query(spark, folder).collect()
                ok, message = True, f"{len(rows)} rows, no SQL, e.g. {rows[:1]}"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += [] if ok else [name]
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("bad:", bad)
