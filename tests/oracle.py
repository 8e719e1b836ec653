"""Compare a Spark result with a DuckDB oracle: row count, column names, order-insensitive values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from courier.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if v is pd.NaT or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        v = v.item()
        if isinstance(v, float):
            return repr(round(v, 6))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(out)


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    s = spark_df.toPandas()
    o = con.sql(sql).df()
    if sorted(s.columns) != sorted(o.columns):
        return False, f"columns {sorted(s.columns)} != {sorted(o.columns)}"
    if len(s) != len(o):
        return False, f"rows {len(s)} != {len(o)}"
    a, b = rows(s), rows(o)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(s)} rows"
