"""Rows of a Spark query against DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def _plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v: object) -> str:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def same(got: pd.DataFrame, sql: str, folder: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and _plain(got) == _plain(want)
