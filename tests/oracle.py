"""A query's rows against DuckDB's, without regard to order; floats to nine digits."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
