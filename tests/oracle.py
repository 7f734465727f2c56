"""Compare registered queries with their SQL in DuckDB, as a test helper."""

from __future__ import annotations

import math
from typing import Any

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, db, sql: str) -> str | None:
    """None when both give the same rows, else what differs first."""
    relation = db.sql(sql)
    columns = list(relation.columns)
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    theirs = canonical(relation.fetchall(), columns)
    ours = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None
