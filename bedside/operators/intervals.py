"""Joins of points to intervals, and intervals built, merged and numbered per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.functions.time import MICROS_PER_HOUR, elapsed_hours, order_micros
from bedside.operators import pieces

BUCKET = "__bucket"
BUCKET_HOURS = 24
# size classes of intervals: powers of two in microseconds, from a second in steps of sixteen to more than any two timestamps are apart
SIZES = tuple(range(20, 61, 4))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    time: str,
    start: str,
    end: str,
    how: str = "left",
    closed: bool = False,
) -> DataFrame:
    """Pair each point with every interval of its entity that holds it.

    ``start <= time < end``, or ``<= end`` when ``closed``; overlapping intervals multiply points. Beside the
    entity both sides carry a time bucket as equality key: a long-lived entity is spread over its buckets, and
    an interval meets only the points of the buckets it touches. An interval is repeated once per bucket, so
    the copies are bounded by its length: this is for windows of hours and days, :func:`attach_intervals` for any others.

    The bucket is not part of the result: an aggregation per (entity, time) that reused its partitioning would
    keep a crowded bucket in one task and forbid the adaptive split of a skewed join. It shuffles the partly
    aggregated matches again instead, which are few beside the points.
    """
    def bucket(at):
        return F.floor(order_micros(at) / F.lit(BUCKET_HOURS * MICROS_PER_HOUR)).cast("long")

    last = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    spread = (
        intervals.filter(last)
        .withColumn(BUCKET, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
        .withColumnsRenamed({start: f"__{start}", end: f"__{end}"})
    )
    keyed = points.withColumn(BUCKET, bucket(F.col(time)))
    p, i = keyed.alias("p"), spread.alias("i")
    match = F.col(f"p.{BUCKET}") == F.col(f"i.{BUCKET}")
    for key in on:
        match = match & (F.col(f"p.{key}") == F.col(f"i.{key}"))
    at, lo, hi = F.col(f"p.{time}"), F.col(f"i.__{start}"), F.col(f"i.__{end}")
    match = match & (at >= lo) & ((at <= hi) if closed else (at < hi))
    taken = [c for c in intervals.columns if c not in on]
    return p.join(i, match, how).select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"i.__{c}" if c in (start, end) else f"i.{c}").alias(c) for c in taken],
    )


def placed_by_size(intervals: DataFrame, start: str, end: str, closed: bool = False) -> DataFrame:
    """Intervals with ``__size``, the exponent of the smallest class they fit in, once per ``__bucket`` of that width they touch.

    An interval is no longer than its buckets are wide, so it touches two at most. ``__from`` and ``__to`` are its ends in microseconds.
    """
    last = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    length = F.col("__to") - F.col("__from")
    size = F.lit(SIZES[-1])
    for exponent in reversed(SIZES[:-1]):
        size = F.when(length <= F.lit(1 << exponent), F.lit(exponent)).otherwise(size)
    sized = intervals.filter(last).withColumns({"__from": order_micros(start), "__to": order_micros(end)}).withColumn("__size", size)
    touched = F.sequence(_bucket("__from"), _bucket("__to"))
    return sized.withColumn("__bucket", F.explode(touched))


def _bucket(at: str):
    return F.call_function("shiftright", F.col(at), F.col("__size"))


def attach_intervals(
    points: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, start: str, end: str, closed: bool = False
) -> DataFrame:
    """Left lookup of all intervals of a point's entity that hold it, whatever their lengths; overlapping ones multiply points.

    Buckets are dyadic: an interval lies in at most two buckets of its own size class, and a time looks into the one bucket of
    each class in use. So short intervals in a crowd and years-long ones of one entity do not disturb each other, and
    nothing has to be known about an entity beforehand. What holds a point depends on its entity and time alone: only the
    different (entity, time) pairs look up, and the points then join what was found. A bucket of a long class with many times is a
    skewed equality join, which the adaptive plan splits.
    """
    placed = placed_by_size(intervals, start, end, closed)
    in_use = F.broadcast(placed.select("__size").distinct())  # at most len(SIZES) rows
    times = points.select(*on, order_micros(time).alias("__t")).filter(pieces.present(*on, "__t")).distinct()
    probes = times.withColumn("__size", F.explode(F.array(*[F.lit(e) for e in SIZES]))).join(in_use, "__size", "left_semi")
    probes = probes.withColumn("__bucket", _bucket("__t"))
    inside = (F.col("__from") <= F.col("__t")) & ((F.col("__t") <= F.col("__to")) if closed else (F.col("__t") < F.col("__to")))
    taken = [c for c in intervals.columns if c not in on]
    found = probes.join(placed, [*on, "__size", "__bucket"]).filter(inside).select(*on, "__t", *[F.col(c).alias(f"__i_{c}") for c in taken])
    held = points.withColumn("__t", order_micros(time)).join(found, [*on, "__t"], "left")
    return held.select(*[F.col(c) for c in points.columns], *[F.col(f"__i_{c}").alias(c) for c in taken])


def attach_interval_value(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    time: str,
    start: str,
    end: str,
    value: str,
) -> DataFrame:
    """Left lookup of the interval value in force at each point."""
    held = attach_intervals(points, intervals.select(*on, start, end, value), on, time, start, end)
    return held.select(*points.columns, value)


def lead_intervals(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    until: str,
    max_rows: int | None = pieces.MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Each reading holds until the next one of its entity, the last until column ``until``.

    Readings at the same time are ordered by value; all but the last of them get an empty interval.
    """
    rows = df.withColumn("__t", order_micros(time))
    sized = None if sized_by is None else sized_by.withColumn("__t", order_micros(time))
    following = pieces.add_next(rows, keys, "__t", {"__next": time}, [value], max_rows, sized)
    return following.select(
        *keys, F.col(time).alias("starttime"), F.coalesce("__next", until).alias("endtime"), F.col(value).alias(value)
    )


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    max_rows: int | None = pieces.MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Union of overlapping or touching closed intervals per entity.

    An interval opens a new island when it starts after everything before it has ended. Intervals that end
    before they start are dropped (deviation: the self join would chain them to later intervals). ``sized_by``
    may name the raw rows (keys, start) behind ``df``, to be counted in its place.
    """
    raw = df.filter(pieces.present(*keys) & (F.col(end) >= F.col(start)))
    raw = raw.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    longest = raw.groupBy(*keys, "__s").agg(F.max("__e").alias("__e"))
    sized = raw if sized_by is None else sized_by.select(*keys, F.col(start).alias("__s"))

    cut = pieces.cut_rows(longest, keys, order_micros("__s"), max_rows, sized)
    w = cut.window("__s")
    cut = cut.carry({"__m": F.max("__e")}, lambda p: {"__earlier": F.max("__m").over(pieces.before(p))})
    reached = F.greatest(F.max("__e").over(pieces.before(w)), F.col("__earlier"))
    cut = cut.with_column("__reached", reached)
    opens = F.col("__reached").isNull() | (F.col("__s") > F.col("__reached"))
    cut = cut.with_column("__open", F.when(opens, F.col("__s")))
    cut = pieces.Pieces(cut.rows.drop("__earlier", "__reached"), cut.keys, cut.cut)
    cut = cut.carry(
        {"__m": F.max("__open")}, lambda p: {"__earlier": F.max("__m").over(pieces.before(p))}, spread=False
    )
    island = F.coalesce(F.max("__open").over(pieces.upto(w)), F.col("__earlier"))
    merged = cut.with_column("__island", island).rows.groupBy(*keys, "__island").agg(F.max("__e").alias(end))
    return merged.select(*keys, F.col("__island").alias(start), end)


def collapse_linked(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One interval per linked order: earliest start, latest end."""
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def number_episodes(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    number: str,
    max_rows: int | None = pieces.MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Episode number per entity by start, and length in hours."""
    numbered = pieces.add_row_number(df, keys, order_micros(start), [end], number, max_rows, sized_by)
    return numbered.select(*keys, number, start, end, elapsed_hours(start, end).alias("duration_hours"))
