"""Table and file scans with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.time import parse_timestamp
from bedside.sources.schemas import column_names


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet scan; with a schema only its columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    timestamps: Sequence[str] = (),
    header: bool = True,
) -> DataFrame:
    """Quoted CSV with a declared schema, empty cells as null, bad rows as an error.

    Columns in ``timestamps`` are declared as text and parsed here, because both ``2040/7/9 08:05:06`` and
    ``2041-11-3 06:30:00`` occur.
    """
    raw = spark.read.csv(path, schema=schema, header=header, mode="FAILFAST", enforceSchema=False if header else True)
    return raw.withColumns({c: _time_or_error(c) for c in timestamps})


def _time_or_error(name: str) -> Column:
    unreadable = F.col(name).isNotNull() & parse_timestamp(name).isNull()
    message = F.concat(F.lit(f"column {name} holds no timestamp: "), F.col(name))
    return F.when(unreadable, F.raise_error(message).cast("timestamp_ntz")).otherwise(parse_timestamp(name))


def read_wide_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Wide measurement file: parses every declared time column present."""
    known = ("intime", "outtime", "og_starttime", "starttime", "endtime", "charttime")
    times = [c for c in known if c in column_names(schema)]
    return read_csv(spark, path, schema, times)


def read_importance(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """Feature-importance files, whose header leaves the first column unnamed; adds the file as ``source``."""
    raw = spark.read.csv(paths, schema=schema, header=header, mode="FAILFAST", enforceSchema=True)
    return raw.withColumn("source", F.input_file_name())
