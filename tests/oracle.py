"""Runs a registered query and its DuckDB counterpart and compares all rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else v)
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark_df, con, sql):
    """Empty if both have the same columns and rows, else what differs."""
    got, want = _plain(spark_df.toPandas()), _plain(con.sql(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} against {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        if not pd.api.types.is_bool_dtype(a) and pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b):
            bad = ~((a - b).abs().fillna(0) <= 1e-9) | (a.isna() != b.isna())
        else:
            bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            return f"{c}: {a[bad].head(3).tolist()} against {b[bad].head(3).tolist()}"
    return ""
