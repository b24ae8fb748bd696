"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.catalog.derived import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as query ``name``; without ``sql`` only its rows are checked."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(*names: str, digits: int = 6):
    """Columns rounded so that the order of a floating sum does not show."""
    return [F.round(n, digits).alias(n) for n in names]


def sql_rounded(expression: str, digits: int = 2) -> str:
    """Half-away-from-zero rounding in decimal arithmetic, as DOUBLE."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


def merged_sql(source: str, key: str) -> str:
    """Unions of touching intervals of ``source`` (``key, starttime, endtime``): starts and ends are marks on the time line, a running
    count says how many intervals are open, and a mark that finds none open begins a new island."""
    order = f"PARTITION BY {key} ORDER BY moment, step DESC"
    return f"""
    SELECT {key}, min(moment) AS starttime, max(moment) AS endtime
    FROM (SELECT *, sum(CASE WHEN step = 1 AND n_open = 1 THEN 1 ELSE 0 END) OVER ({order}, step * n_open ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, sum(step) OVER ({order} ROWS UNBOUNDED PRECEDING) AS n_open
                FROM (SELECT {key}, unnest([starttime, endtime]) AS moment, unnest([1, -1]) AS step FROM {source} WHERE endtime >= starttime)))
    GROUP BY {key}, island"""
