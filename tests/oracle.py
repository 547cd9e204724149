"""Comparison of a Spark result with DuckDB's over the same tables."""

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{source}')")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return "null" if value is None else str(value)


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted("|".join(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want
