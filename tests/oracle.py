"""Hold a query against its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return round(float(v), 9)
    return str(v)


def _rows(frame, columns):
    return sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


def run_sql(sql, sf_dir, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.register(f"_{name}", frame)
        con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM _{name}")
    return con.sql(sql).df()


def same(df, sql, sf_dir):
    got, want = df.toPandas(), run_sql(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)
