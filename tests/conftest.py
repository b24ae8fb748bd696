from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame(ddl, rows)`` with ISO text accepted for timestamps."""
    from datetime import date, datetime

    from pyspark.sql.types import DateType, StructType, TimestampNTZType

    def build(ddl, rows):
        schema = StructType.fromDDL(ddl)

        def cell(value, field):
            if isinstance(value, str) and isinstance(field.dataType, TimestampNTZType):
                return datetime.fromisoformat(value)
            if isinstance(value, str) and isinstance(field.dataType, DateType):
                return date.fromisoformat(value)
            return value

        typed = [tuple(cell(v, f) for v, f in zip(row, schema.fields)) for row in rows]
        return spark.createDataFrame(typed, schema)

    return build


def rows_of(df, *columns):
    """Sorted tuples of the given columns, nulls first."""
    picked = df.select(*columns) if columns else df
    return sorted(map(tuple, picked.collect()), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.fixture
def rows():
    return rows_of
