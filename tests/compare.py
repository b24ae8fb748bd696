"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, connection, sql) -> str | None:
    """None when columns and row multisets agree, else a short account of what differs."""
    ours = frame.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    a, b = bag(frame.columns, ours), bag(names, theirs)
    if a == b:
        return None
    return f"{len(ours)} rows against {len(theirs)}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
