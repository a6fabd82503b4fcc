"""A query's rows and those of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value: object) -> object:
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    value = value.item() if hasattr(value, "item") and not hasattr(value, "__len__") else value
    if isinstance(value, float):  # pandas shows whole numbers as floats where others are null
        return str(int(value)) if value.is_integer() else repr(round(value, 6))
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(([tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]), key=repr)
