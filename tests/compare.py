"""Run registered queries beside their SQL and compare the rows, whatever their order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else a message."""
    df = fn(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = normal([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "the SQL gives no rows"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lacking = [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}\n  spark only {extra}\n  sql only {lacking}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"\n  spark {a}\n  sql   {b}"
    return None


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from treesift.session import get_spark

    spark = get_spark(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            message = compare(spark, con, name, fn, sql.get(name), folder)
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {took:.1f}s {message or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1], sys.argv[2:])
