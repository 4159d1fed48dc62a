"""Compare a Spark result with its SQL on the same tables, order of rows aside."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if v is None or (isinstance(v, float) and pd.isna(v)) else v

    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is not None, str(type(v)), v) for v in row])


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs first."""
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = _rows(theirs_columns, result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} / {sorted(theirs_columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows, columns {sorted(df.columns)}, first {bad[0]}"
    types = [
        (a, b)
        for row, other in zip(ours, theirs)
        for a, b in zip(row, other)
        if a is not None and type(a) is not type(b)
    ]
    return f"types {types[0]}" if types else None


def main(sf_dir: str, names: list[str]) -> int:
    """Compare the named queries, or all, and print one line for each."""
    from clustrial.checks.oracles import ORACLES
    from clustrial.checks.queries import QUERIES
    from clustrial.session import local_session

    spark, con, failed = local_session("compare"), connect(sf_dir), 0
    for name in names or QUERIES:
        found = difference(QUERIES[name](spark, sf_dir), con, ORACLES[name])
        failed += found is not None
        print(f"{name:32s} {found or 'same'}"[:600], flush=True)
    spark.stop()
    print(f"{failed} different")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
