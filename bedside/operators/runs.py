"""Dose runs from point readings of a pump: carry-forward of the rate, start and stop flags, episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.functions.time import order_micros
from bedside.operators import pieces


def dose_runs(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    rate: str,
    stopped: str,
    max_rows: int | None = pieces.MAX_ROWS,
) -> DataFrame:
    """Start and end of each delivery of one drug to one entity; ``keys`` are (entity, drug).

    ``stopped`` is 1 on a disconnect. Readings at one time are first reduced to their maximum. A missing rate
    means "as before", so the rate in force is the last known one. A run starts at the first positive rate,
    after a zero rate, or after a disconnect; it ends at the first disconnect, zero rate or last reading that
    carries its number. Runs without a positive rate or without length are dropped.
    """
    raw = df.filter(pieces.present(*keys))
    readings = (
        raw.groupBy(*keys, F.col(time).alias("__at"))
        .agg(F.max(rate).alias("__rate"), F.max(stopped).alias("__stopped"))
        .withColumn("__t", order_micros("__at"))
    )
    cut = pieces.cut_rows(readings, keys, "__t", max_rows, sized_by=raw.withColumn("__t", order_micros(time)))
    w = cut.window("__t")

    # what other pieces hold: last known rate, last disconnect flag, and whether a later piece exists
    cut = cut.carry(
        {
            "__known": F.max_by("__rate", F.when(F.col("__rate").isNotNull(), F.col("__t"))),
            "__last_stop": F.max_by("__stopped", "__t"),
        },
        lambda p: {
            "__c_rate": F.last("__known", ignorenulls=True).over(pieces.before(p)),
            "__c_stop": F.lag("__last_stop").over(p),
            "__c_more": F.lead(F.lit(1)).over(p),
        },
    )
    cut = (
        cut.with_column(
            "__before", F.coalesce(F.last("__rate", ignorenulls=True).over(pieces.before(w)), F.col("__c_rate"))
        )
        .with_column("__now", F.coalesce("__rate", "__before"))
        .with_column("__prev_stop", F.coalesce(F.lag("__stopped").over(w), F.col("__c_stop")))
        .with_column("__is_last", F.lead("__t").over(w).isNull() & F.col("__c_more").isNull())
        .with_column("__start", _start_flag())
    )
    cut = cut.carry(
        {"__n": F.sum("__start")}, lambda p: {"__c_run": F.sum("__n").over(pieces.before(p))}, spread=False
    )
    here = F.coalesce(F.sum("__start").over(pieces.upto(w)), F.lit(0))
    ends = (F.col("__stopped") == 1) | F.coalesce(F.col("__rate") == 0, F.lit(False)) | F.col("__is_last")
    return (
        cut.with_column("run", here + F.coalesce("__c_run", F.lit(0)))
        .rows.filter("run > 0")
        .groupBy(*keys, "run")
        .agg(
            F.min(F.when(F.col("__rate").isNotNull(), F.col("__at"))).alias("starttime"),
            F.min(F.when(ends, F.col("__at"))).alias("endtime"),
            F.min("__at").alias("__first"),
            F.max("__rate").alias("__peak"),
        )
        .filter((F.col("__first") != F.col("endtime")) & (F.col("__peak") > 0))
        .select(*keys, "run", "starttime", "endtime")
    )


def _start_flag():
    """1 opens a run, 0 continues a stretch of zeros, null leaves the run as it is."""
    rate, before, now = F.col("__rate"), F.col("__before"), F.col("__now")
    return (
        F.when((rate > 0) & before.isNull(), 1)
        .when((before == 0) & (now == 0), 0)
        .when(before == 0, 1)
        .when(F.col("__prev_stop") == 1, 1)
    )
