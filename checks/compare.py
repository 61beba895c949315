"""Run the queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.oracles import oracle_sql
from checks.queries import queries
from maskwright.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def compare(spark, con, name: str, sf: str) -> tuple[str, float]:
    """``ok`` or what differs, and the seconds of the Spark query."""
    start = time.time()
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only ({sum(got.values())})", seconds
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != columns:
        return f"columns differ: {columns} / {sorted(names)}", seconds
    order = [names.index(c) for c in columns]
    want = Counter(tuple(_plain(row[i]) for i in order) for row in answer.fetchall())
    if got == want:
        return f"ok ({sum(got.values())})", seconds
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"differs: {sum(got.values())} / {sum(want.values())} rows\n  spark {extra}\n  sql   {missing}", seconds


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    con = connect(sf)
    bad = 0
    for name in names:
        try:
            verdict, seconds = compare(spark, con, name, sf)
        except Exception as exc:
            verdict, seconds = f"failed: {str(exc)[:1500]}", 0.0
        bad += verdict.startswith(("differs", "failed", "columns"))
        print(f"{name}: {verdict[:1500]} {seconds:.2f}s", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
