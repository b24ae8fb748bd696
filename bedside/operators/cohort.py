"""Eligibility, index events, evidence gates and case/control windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.time import elapsed_days, elapsed_hours, plus_hours
from bedside.operators.intervals import interval_join


def eligible_by_measure(
    spine: DataFrame,
    measures: DataFrame,
    stay: str,
    on: Sequence[str],
    start: str,
    end: str,
    time: str,
    value: str,
    min_count: int,
    first_at_most: float,
    lead_in_hours: int = 0,
) -> DataFrame:
    """Stays with at least ``min_count`` readings in [start, end] whose first one is at most ``first_at_most``.

    The first reading is looked for from ``lead_in_hours`` before the start; of several at that time one that
    passes is enough. One join and one aggregation decide both; the result is a semi join, so a stay is never
    repeated (deviation: joining back to the first reading would repeat it on ties).
    """
    windows = spine.select(stay, *[c for c in on if c != stay], F.col(start).alias("__s"), F.col(end).alias("__e"))
    windows = windows.withColumn("__from", plus_hours("__s", -lead_in_hours))
    held = interval_join(measures.select(*on, time, value), windows, on, time, "__from", "__e", "inner", closed=True)
    decided = held.groupBy(stay).agg(
        F.count(F.when(F.col(time) >= F.col("__s"), F.col(time))).alias("__n"),
        # nulls sort last in the struct minimum, so an unknown first value only counts if nothing else is there
        F.min(F.struct(F.col(time), F.col(value).isNull().alias("gap"), F.col(value).alias("value"))).alias("__first"),
    )
    passed = decided.filter((F.col("__n") >= min_count) & (F.col("__first.value") <= first_at_most))
    return spine.join(passed.select(stay), stay, "left_semi")


def first_event(
    readings: DataFrame,
    spine: DataFrame,
    stay: str,
    time: str,
    low: Column,
    end: str,
    days_before_end: float = 1.0,
    values: Sequence[str] = (),
) -> DataFrame:
    """Earliest reading per stay that satisfies ``low`` and lies ``days_before_end`` or more before the end.

    Later readings are only nearer to the end, so the stay's minimum decides; it is combined on the map side
    and one row per stay reaches the join. ``values`` of that reading come along in the same aggregation,
    which spares joining back to the readings; (stay, time) is unique then.
    """
    earliest = readings.filter(low).groupBy(stay).agg(F.min(F.struct(time, *values)).alias("__first"))
    earliest = earliest.select(stay, "__first.*")
    late_enough = F.round(elapsed_days(time, end), 4) >= days_before_end
    kept = earliest.join(spine.select(stay, end), stay, "inner").filter(late_enough)
    return kept.select(stay, time, *values)


def value_at_event(
    readings: DataFrame, first: DataFrame, stay: str, time: str, columns: Sequence[Column | str]
) -> DataFrame:
    """The readings taken at each stay's index event, with chosen columns."""
    return readings.join(first.select(stay, time), [stay, time], "inner").select(stay, time, *columns)


def evidence_gate(
    first: DataFrame, evidence: DataFrame, stay: str, event_time: str, time: str, hours_after: int = 24
) -> DataFrame:
    """Index events with at least one evidence row in [event, event + hours_after].

    ``evidence`` is already filtered to what counts. The events' own columns ride through the join and are
    made distinct on the map side, so neither side is read twice.
    """
    windows = first.withColumn("__from", F.col(event_time)).withColumn("__to", plus_hours(event_time, hours_after))
    marks = evidence.select(stay, F.col(time).alias("__seen"))
    seen = interval_join(marks, windows, [stay], "__seen", "__from", "__to", "inner", closed=True)
    return seen.select(*first.columns).distinct()


def hours_to_event(start: str, event: str) -> Column:
    return F.round(elapsed_hours(start, event), 0)


def exclude_if_exists(df: DataFrame, bad: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop entities that occur in ``bad``, reduced to distinct keys first so a hot key stays one row."""
    return df.join(bad.select(*on).distinct(), list(on), "left_anti")


def label_and_window(
    base: DataFrame, events: DataFrame, stay: str, intime: str, event_time: str, hours: str, min_hours: int = 24
) -> DataFrame:
    """Label stays and place their observation window.

    Stays with an event earlier than ``min_hours`` are dropped. A case (label 1) is observed from
    ``min_hours`` before its event, a control (label 0) from admission.
    """
    early = events.filter(F.col(hours) < min_hours)
    kept = exclude_if_exists(base, early, [stay])
    marked = kept.join(events.select(stay, event_time, hours), stay, "left")
    # an event whose hour is unknown is no case, like a stay without an event
    case = F.coalesce(F.col(hours) >= min_hours, F.lit(False))
    return marked.select(
        *base.columns,
        F.when(case, plus_hours(event_time, -min_hours)).otherwise(F.col(intime)).alias("starttime"),
        event_time,
        case.cast("int").alias("og_label"),
    )
