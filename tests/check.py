"""Compares every registered query with its oracle: `python tests/check.py [folder] [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got)}" if got else "EMPTY"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}"
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"DIFF {len(got)} {len(want)} {only}"
    return f"ok {len(got)}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from framesift.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    con, sqls = connect(folder), oracle_sql()
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            text = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:
            text = f"FAIL {type(e).__name__} {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {text}", flush=True)


if __name__ == "__main__":
    main()
