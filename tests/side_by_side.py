"""Rows of a query and of its SQL in a form that can be compared."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))
