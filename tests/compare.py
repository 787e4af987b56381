"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

As a script: python tests/compare.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(directory, f"{table}.parquet")
        if os.path.exists(path):
            connection.execute(f"create view {table} as select * from read_parquet('{path}')")
    return connection


def _text(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_text(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def differences(spark, connection, directory: str, name: str, query, sql: str) -> list[str]:
    """What differs between both sides; empty when they agree."""
    df = query(spark, directory)
    mine = _rows(df.columns, df.collect())
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = _rows(columns, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(columns):
        found.append(f"columns {sorted(df.columns)} against {sorted(columns)}")
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    if not found and mine != theirs:
        pairs = [(a, b) for a, b in zip(mine, theirs) if a != b]
        found.append(f"{len(pairs)} rows differ, e.g. {pairs[0][0]} against {pairs[0][1]}")
    if not mine:
        found.append("no rows")
    return found


def main() -> int:
    import __spark_entry__ as entry
    from orderloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = tuple(sys.argv[2:])
    directory = f"/root/testdata/sf{sf}"
    spark = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="orderloom-compare-")})
    connection = connect(directory)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not name.startswith(wanted):
            continue
        begin = time.time()
        try:
            if name in sql:
                found = differences(spark, connection, directory, name, query, sql[name])
            else:
                found = [] if query(spark, directory).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(found)
        label = "ok" if not found else "DIFFERS " + "; ".join(found)
        print(f"{time.time() - begin:6.2f}s {name}{'' if name in sql else ' (no sql)'}: {label}", flush=True)
    print(f"{bad} differ")
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())
