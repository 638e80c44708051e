"""Run queries and their SQL on one folder of tables; print what differs. python tests/compare_with_sql.py FOLDER [NAME...]"""

import math
import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def difference(spark, con, folder, f, sql):
    got = f(spark, folder)
    a, x = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    b, y = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    odd = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(odd)} of {len(x)} rows, {odd[:3]}" if odd else None


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, names = connect(sys.argv[1]), sys.argv[2:]
    all_queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or all_queries:
        began = time.time()
        try:
            said = difference(spark, con, sys.argv[1], all_queries[name], sql[name]) if name in sql else f"no SQL; {all_queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:500]}"
            if names:
                traceback.print_exc()
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
