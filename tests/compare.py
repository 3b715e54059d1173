"""A Spark result against a DuckDB result, as sorted rows of plain values."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, str):
        return v
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    return round(float(v), 6)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


def same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = rows(got), rows(wanted)
    assert a == b, f"only Spark: {sorted(set(a) - set(b))[:3]}; only DuckDB: {sorted(set(b) - set(a))[:3]}"
