"""Time arithmetic on TIMESTAMP_NTZ columns that does not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    """Elapsed microseconds from ``start`` to ``end`` as BIGINT, exact.

    Goes through the interval, since ``timestampdiff`` reads its arguments in the session zone and is an hour
    off for times that a daylight-saving change skips there.
    """
    elapsed = _col(end).cast("timestamp_ntz") - _col(start).cast("timestamp_ntz")
    return (elapsed.cast("interval second").cast("decimal(18,6)") * F.lit(MICROS_PER_SECOND)).cast("long")


def order_micros(ts) -> Column:
    """BIGINT order key of a timestamp, usable in ``rangeBetween`` frames."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def elapsed_hours(start, end) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def elapsed_days(start, end) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def hours(n: int) -> Column:
    """A day-time interval of ``n`` hours (may be negative)."""
    return F.make_dt_interval(F.lit(0), F.lit(n))


def plus_hours(ts, n: int) -> Column:
    return _col(ts) + hours(n)


def parse_timestamp(text) -> Column:
    """Text to TIMESTAMP_NTZ for both file layouts, ``2040/7/9 08:05:06`` and ``2041-11-3 06:30:00``.

    Text that is no timestamp becomes null.
    """
    return F.translate(_col(text), "/", "-").try_cast("timestamp_ntz")


def age_in_years(birth, at) -> Column:
    """Whole days between two dates over the mean year length, two decimals."""
    return F.round(F.datediff(_col(at).cast("date"), _col(birth).cast("date")) / F.lit(365.242), 2)
