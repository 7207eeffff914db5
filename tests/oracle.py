"""Compare registered queries with their SQL: python tests/oracle.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"f{round(v, 6):.6f}"
    if isinstance(v, bool):
        return f"b{v}"
    return repr(v) if isinstance(v, int) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got[1])})", spent
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    spent_sql = time.time() - t
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spent
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"DIFF spark={len(got[1])} sql={len(want[1])}\n   spark only {sorted(a)[:3]}\n   sql only   {sorted(b)[:3]}", spent
    return f"ok {len(got[1])} rows (sql {spent_sql:.1f}s)" + ("  EMPTY" if not got[1] else ""), spent


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "sf0.01"
    d = f"/root/testdata/{sf}"
    # a plain session, as the queries must not depend on our settings
    spark = (SparkSession.builder.master("local[8]").appName("oracle").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = []
    for name in args[1:] or list(entry.queries()):
        try:
            verdict, spent = compare(spark, con, name, d)
        except Exception as e:  # noqa: BLE001
            verdict, spent = "ERROR " + type(e).__name__ + " " + str(e)[:600], 0
        if not verdict.startswith(("ok", "rows only")):
            bad.append(name)
        print(f"{name:26} {spent:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
