"""Comparison of a query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(normal(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((normal(k), normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(normal(x) for x in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[c]) for c in names) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr)


def duck_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
