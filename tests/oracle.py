"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return round(value, 9) if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    df = fn(spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    expected_names, want = _rows(list(relation.columns), relation.fetchall())
    if names != expected_names:
        return f"columns {names} / {expected_names}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows / {len(want)} rows; spark {only_got}; sql {only_want}"
    return None if got else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = build_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, queries[name], sql[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s",
              found or "", flush=True)


if __name__ == "__main__":
    main()
