"""Compare registered queries with their DuckDB counterparts: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Value with its kind, so that 1, 1.0, '1' and True all differ."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    if isinstance(value, int):
        return ("int", value)
    return (type(value).__name__, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(mine)}" if mine else "EMPTY"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if mine != theirs:
        extra, absent = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return f"VALUES rows {len(mine)} / {len(theirs)}\n   spark only {extra}\n   duckdb only {absent}"
    return f"ok {len(mine)}" if mine else "EMPTY"


def main() -> int:
    from tidemark.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="tidemark-oracle-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failures = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            result = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as error:
            result = f"ERROR {str(error)[:1500]}"
        failures += not result.startswith(("ok", "rows only"))
        print(f"{name:32} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
