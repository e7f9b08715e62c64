"""Run registered queries beside their SQL twins: python tests/check.py [sf] [name ...].

PLAIN_SESSION=1 takes a session without any settings.
"""

import datetime
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from answerloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return 0.0 if value == 0 else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no sql  {name}: {len(got)} rows, spark {t1 - t0:.1f}s", True
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    t2 = time.time()
    note = f"{name}: {len(got)} / {len(want)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {note} {df.columns} {columns}", False
    types = {c[0]: str(c[1]) for c in rel.description}
    clash = [(f, t, types[f]) for f, t in df.dtypes if SQL_TYPES.get(t, types[f]) != types[f]]
    if clash:
        return f"TYPES   {note} {clash}", False
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"DIFFERS {note}\n   {sorted(df.columns)}\n   spark {sorted(a - b)[:2]}\n   sql   {sorted(b - a)[:2]}", False
    return f"equal   {note}", True


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    if os.environ.get("PLAIN_SESSION"):
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g").getOrCreate()
    else:
        spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    good = True
    for name in sys.argv[2:] or entry.queries():
        try:
            line, ok = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            line, ok = f"FAILED  {name}: {type(e).__name__} {str(e)[:1500]}", False
        good &= ok
        print(line, flush=True)
    sys.exit(0 if good else 1)
