"""Run registered queries next to their SQL and compare, as sets of rows.

``python -m tests.oracle [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ if v is not None else ""), str(v)) for v in row)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> str:
    start = time.time()
    frame = query(spark, folder)
    names = sorted(frame.columns)
    mine = sorted((tuple(plain(v) for v in row) for row in frame.select(*names).collect()), key=sort_key)
    took = time.time() - start
    if sql is None:
        return f"rows  {name:28s} {len(mine):7d} rows  {took:5.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    sql_took = time.time() - start
    if sorted(columns) != names:
        return f"FAIL  {name}: columns {names} / {sorted(columns)}"
    order = [columns.index(n) for n in names]
    theirs = sorted((tuple(plain(row[i]) for i in order) for row in rows), key=sort_key)
    if mine == theirs:
        return f"ok    {name:28s} {len(mine):7d} rows  {took:5.1f}s  sql {sql_took:5.1f}s"
    only_mine = [r for r in mine if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(mine)][:2]
    return (
        f"FAIL  {name}: {len(mine)} / {len(theirs)} rows\n      columns {names}\n"
        f"      only spark {str(only_mine)[:700]}\n      only sql   {str(only_theirs)[:700]}"
    )


def main() -> None:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry

    from chunkweave.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            print(compare(spark, con, name, query, sql.get(name), folder), flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
