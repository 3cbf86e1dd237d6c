"""Run a query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from tonearm import plans
from tonearm.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.6f}"
    if type(value).__name__ == "Decimal":
        return f"DECIMAL {value}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float, float]:
    start = time.time()
    df = plans.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return ("rows-only", len(got), spark_time, 0.0)
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_time = time.time() - start
    if sorted(df.columns) != sorted(names):
        return (f"COLUMNS {sorted(df.columns)} != {sorted(names)}", len(got), spark_time, duck_time)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return (
            f"DIFF spark {len(a)} duck {len(b)}; only spark {sorted(sa - sb)[:3]}; only duck {sorted(sb - sa)[:3]}",
            len(got), spark_time, duck_time,
        )
    return ("ok" if a else "ok (EMPTY)", len(got), spark_time, duck_time)


def main() -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(plans.queries())
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            status, n, a, b = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            lines = [x for x in str(error).splitlines() if x.strip()]
            status, n, a, b = "ERROR " + type(error).__name__ + " " + " ".join(lines[:6])[:900], 0, 0.0, 0.0
        bad += not status.startswith(("ok", "rows"))
        print(f"{name:28s} rows={n:7d} spark={a:6.2f}s duck={b:6.2f}s {status}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
