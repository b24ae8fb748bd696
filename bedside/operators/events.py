"""Signed totals and code-merged readings from long event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_total(
    df: DataFrame,
    keys: Sequence[str],
    code: str,
    value: str,
    codes: Sequence,
    negative: Sequence,
    below: float,
    name: str = "value",
) -> DataFrame:
    """Sum per key over the wanted codes, ``negative`` codes counting against it; oversized values are left out."""
    kept = df.filter(F.col(code).isin(*codes) & (F.col(value) < below))
    signed = F.when(F.col(code).isin(*negative), -F.col(value)).otherwise(F.col(value))
    return kept.groupBy(*keys).agg(F.sum(signed).alias(name))


def first_min_max(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """First, smallest and largest value per key in one aggregation; ties in time take the smaller value.

    A row without a time is first only if its key has no other.
    """
    return df.groupBy(*keys).agg(
        F.min(F.struct(F.col(time).isNull(), F.col(time), F.col(value)))[value].alias(f"first_{value}"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )


def remap(code: str, groups: dict) -> Column:
    """Common name of a code that several systems write differently: ``{name: codes}``."""
    return F.coalesce(*[F.when(F.col(code).isin(*codes), F.lit(name)) for name, codes in groups.items()])
