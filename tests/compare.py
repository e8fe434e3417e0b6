"""Run registered queries next to their SQL: ``python tests/compare.py [sf] [names…]``."""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (decimal.Decimal, float)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def oracle_table(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    return table_of([d[0] for d in result.description], result.fetchall())


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def difference(got, expected):
    if got == expected:
        return None
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    a, b = set(got[1]), set(expected[1])
    return f"rows {len(got[1])} / {len(expected[1])}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from gridloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            got = spark_table(fn(spark, sf_dir))
            took = time.time() - start
            note = "rows only" if name not in sqls else difference(got, oracle_table(sf_dir, sqls[name]))
            bad += note not in (None, "rows only")
            print(f"{name:22s} {took:6.2f}s {len(got[1]):7d} {(note or 'ok')[:700]}", flush=True)
        except Exception as e:
            bad += 1
            print(f"{name:22s} ERROR {type(e).__name__}: {str(e)[:500]}", flush=True)
    print("bad:", bad)
