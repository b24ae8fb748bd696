"""Windowed pivots of long measurements to wide rows, and slices in relative time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.time import elapsed_hours
from bedside.operators.intervals import interval_join


@dataclass(frozen=True)
class Measure:
    """One wide column: item codes, the open range a value must lie in, and an optional conversion.

    ``above``/``below`` are strict, ``at_most`` is inclusive. ``convert`` is SQL over ``value``; ``text``
    takes the raw text column instead of the number.
    """

    codes: tuple
    above: float | None = None
    below: float | None = None
    at_most: float | None = None
    convert: str | None = None
    text: bool = False

    def when(self, code: str, number: str, text: str) -> str:
        """The measure as one WHEN arm."""
        held = [f"`{code}` IN ({', '.join(map(_literal, self.codes))})"]
        for sign, bound in ((">", self.above), ("<", self.below), ("<=", self.at_most)):
            if bound is not None:
                held.append(f"`{number}` {sign} {float(bound)}D")
        taken = f"`{text}`" if self.text else (self.convert or "value").replace("value", f"`{number}`")
        return f"WHEN {' AND '.join(held)} THEN {taken}"


def _literal(code) -> str:
    return "'" + code.replace("'", "\\'") + "'" if isinstance(code, str) else str(code)


Spec = dict[str, tuple[Measure, ...]]


def spec_codes(spec: Spec) -> list:
    return sorted({code for measures in spec.values() for m in measures for code in m.codes})


def pivot_columns(spec: Spec, code: str, number: str, text: str = "value") -> list[Column]:
    """``max`` per wide column over the rows whose code and value fit one of its measures."""
    return [
        F.expr(f"max(CASE {' '.join(m.when(code, number, text) for m in measures)} END)").alias(name)
        for name, measures in spec.items()
    ]


def pivot_measurements(
    cohort: DataFrame,
    events: DataFrame,
    spec: Spec,
    on: Sequence[str],
    start: str | Column,
    end: str | Column,
    time: str = "charttime",
    code: str = "itemid",
    number: str = "valuenum",
    text: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (cohort row, time) inside the closed window ``[start, end]``, one column per measure.

    The code filter sits on the events scan, since a filter cannot be derived from ``max(when)``. ``keep``
    names cohort columns to group by beside ``on``. Cohort rows without a fitting event give no row.
    """
    wanted = events.filter(F.col(code).isin(spec_codes(spec)))
    texts = [text] if any(m.text for ms in spec.values() for m in ms) else []
    wanted = wanted.select(*on, time, code, number, *texts)
    extra = [c for c in keep if c not in on]
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    spine = cohort.select(*on, *extra, start.alias("__from"), end.alias("__to"))
    held = interval_join(wanted, spine, on, time, "__from", "__to", how="inner", closed=True)
    return held.groupBy(*on, *extra, time).agg(*pivot_columns(spec, code, number, text))


def slice_relative(
    wide: DataFrame,
    anchors: DataFrame,
    on: Sequence[str],
    anchor: str,
    start: Column,
    end: Column,
    hour: Column | None = None,
    time: str = "charttime",
    name: str = "charthour",
) -> DataFrame:
    """Wide rows inside ``[start, end]`` around each entity's anchor, with their hour relative to it.

    ``hour`` overrides the default, hours since the anchor with two decimals. Entities without a row in the
    window yield none (a left join would give a row of nulls that every later step drops).
    """
    spine = anchors.select(*on, F.col(anchor).alias("__anchor"), start.alias("__from"), end.alias("__to"))
    held = interval_join(wide, spine, on, time, "__from", "__to", how="inner", closed=True)
    hour = hour if hour is not None else F.round(elapsed_hours("__anchor", time), 2)
    return held.select(*wide.columns, hour.alias(name))


def hours_before_anchor(time: str = "charttime", offset: float = 24.0) -> Column:
    """``offset`` minus the hours left until the anchor, two decimals."""
    return F.lit(offset) - F.round(elapsed_hours(time, "__anchor"), 2)



def timeline(
    wide: DataFrame, spine: DataFrame, on: Sequence[str], origin: str, event: str, time: str = "charttime"
) -> DataFrame:
    """Wide rows with hours since ``origin`` and the three marker hours event - 24, event, event + 24."""
    marked = spine.select(
        *on,
        F.col(origin).alias("__origin"),
        F.round(elapsed_hours(origin, event), 2).alias("og_start_h"),
    )
    return wide.join(marked, list(on), "inner").select(
        *wide.columns,
        F.round(elapsed_hours("__origin", time), 2).alias("charttime_h"),
        (F.col("og_start_h") - 24).alias("window_start_h"),
        "og_start_h",
        (F.col("og_start_h") + 24).alias("window_end_h"),
    )


def episode_hours(
    episodes: DataFrame, spine: DataFrame, on: Sequence[str], origin: str, start: str = "starttime", end: str = "endtime"
) -> DataFrame:
    """Episodes with start and end in hours since ``origin``, one decimal."""
    return episodes.join(spine.select(*on, F.col(origin).alias("__origin")), list(on), "inner").select(
        *episodes.columns,
        F.round(elapsed_hours("__origin", start), 1).alias("starttime_h"),
        F.round(elapsed_hours("__origin", end), 1).alias("endtime_h"),
    )
