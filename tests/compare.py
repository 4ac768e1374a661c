"""python tests/compare.py FOLDER [NAME...]: every query against its SQL in DuckDB."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "Row":
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "[" + ",".join(canon(x) for x in v.values()) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name, query, sql, folder):
    """None if they agree, else what differs."""
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine is not None else "no rows"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"rows {len(mine)} and {len(theirs)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return None


def main(folder, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if names and not any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        began = time.time()
        try:
            why = compare(spark, con, name, query, sql.get(name), folder)
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'BAD '} {name} {time.time() - began:.1f}s{'' if name in sql else ' (no SQL)'} {why or ''}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
