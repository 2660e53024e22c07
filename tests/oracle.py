"""Compare a registered Spark query with its DuckDB oracle (driver-style check)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas turns null longs into NaN
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if st != dt:
        return False, f"types differ: {[(k, st.get(k), dt.get(k)) for k in st if st.get(k) != dt.get(k)]}"
    sp = sdf.toPandas()
    dk = con.execute(sql).df()
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    if len(sp) != len(dk):
        return False, f"row count spark={len(sp)} duck={len(dk)}"
    a, b = rows(sp), rows(dk)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {bad}"
    return True, f"{len(sp)} rows"
