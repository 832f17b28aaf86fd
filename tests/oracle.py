"""Compare a named query with its SQL in DuckDB.

``python -m tests.oracle /root/testdata/sf0.01 [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: [(v is not None, str(type(v)), str(v)) for v in r])


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), _rows(names, cursor.fetchall())


def difference(con: duckdb.DuckDBPyConnection, df: DataFrame, sql: str) -> str | None:
    """None when both agree exactly, else what differs first."""
    got_names, got = spark_rows(df)
    want_names, want = oracle_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} instead of {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}; extra {[r for r in got if r not in want][:3]}; missing {[r for r in want if r not in got][:3]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0][0]} instead of {wrong[0][1]}"
    types_got = [type(v).__name__ for v in got[0]] if got else []
    types_want = [type(v).__name__ for v in want[0]] if want else []
    return None if types_got == types_want or not got else f"types {types_got} instead of {types_want}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tallyspark.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark: SparkSession = local_session()
    con, oracles = connect(folder), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.perf_counter()
        try:
            if name in oracles:
                problem = difference(con, build(spark, folder), oracles[name])
            else:
                problem = None if spark_rows(build(spark, folder))[1] else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        status = "ok  " if problem is None else "BAD "
        print(f"{status} {name:32s} {time.perf_counter() - start:6.2f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
