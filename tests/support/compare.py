"""Runs registered queries in Spark and their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def duck_rows(con, sql):
    out = con.execute(sql)
    return _rows([d[0] for d in out.description], out.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tidewire.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            t0 = time.time()
            got = spark_rows(fn(spark, sf_dir))
            t1 = time.time()
            if name in sqls:
                problem = difference(got, duck_rows(con, sqls[name]))
            else:
                problem = None
            t2 = time.time()
        except Exception as error:  # report and go on with the next query
            problem, t1, t2, got = f"{type(error).__name__}: {str(error)[:1500]}", t0, t0, ([], [])
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={len(got[1]):7d} spark={t1-t0:6.2f}s "
              f"duck={t2-t1:5.2f}s {'' if name in sqls else '(no sql)'} {problem or ''}", flush=True)
    print("failures:", bad)
