"""Runs registered queries next to their SQL twins in DuckDB and compares
columns and values, order aside. ``python tests/compare.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
         .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(path: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, path, queries, oracle):
    t = time.time()
    df = queries[name](spark, path)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if name not in oracle:
        return "rows-only", len(got), spent, ""
    cur = con.execute(oracle[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), spent, f"{df.columns} vs {cols}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return "COUNT", len(got), spent, f"{len(a)} vs {len(b)}; spark {a[:2]} duck {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", len(got), spent, f"{len(bad)} differ; {sorted(cols)} first {bad[0][0]} vs {bad[0][1]}"
    return ("ok" if a else "ok-empty"), len(a), spent, ""


def main():
    import __spark_entry__ as e
    sf, names = sys.argv[1], sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(path)
    qs, oracle = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or qs:
        try:
            status, n, spent, note = compare(spark, con, name, path, qs, oracle)
        except Exception as ex:  # report and go on
            status, n, spent, note = "ERROR", 0, 0, str(ex)[:700]
        failed += not status.startswith(("ok", "rows"))
        print(f"{status:9} {name:28} rows={n} {spent:.1f}s {note}", flush=True)
    print(f"{failed} failed of {len(names or qs)}")


if __name__ == "__main__":
    main()
