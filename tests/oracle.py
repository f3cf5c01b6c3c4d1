"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else (f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True) if len(df.columns) else df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = ~((a == b) | (a.isna() & b.isna())).all(axis=1)
    return f"{int(bad.sum())} rows differ:\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}" if bad.any() else ""
