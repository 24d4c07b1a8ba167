"""Side-by-side run of the registered queries and their SQL.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, int(value))
    if isinstance(value, float):
        return (1, 0.0 if value == 0 or math.isnan(value) else float(f"{value:.9g}"))
    return (1, float(value)) if isinstance(value, int) else (2, str(value))


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str, run, sql: str | None) -> str:
    """Empty text when equal, else what differs."""
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    found = connection.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} rows differ, first {str(different[0])[:600]}"
    return ""


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    connection = connect(folder)
    oracles, bad = oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name, run, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        kind = "" if name in oracles else " (rows only)"
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}{kind}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
