"""Labelled-field capture from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture(text: Column, pattern: str) -> Column:
    """First group of the first match, null without a match; ``.`` spans line ends."""
    spanning = f"(?s){pattern}"
    return F.when(text.rlike(spanning), F.regexp_extract(text, spanning, 1))


def capture_number(text: Column, pattern: str) -> Column:
    """Captured text as DOUBLE; de-identified text (with ``*``) and other non-numbers are null."""
    found = capture(text, pattern)
    return F.when(~found.contains("*"), F.trim(found).try_cast("double"))


def contains_ignoring_case(text, needle: str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.lower(column).contains(needle)


def first_keyword(text, mapping: dict[str, str]) -> Column:
    """Value of the first key of ``mapping`` found in ``text`` (case ignored), else null."""
    rungs = [(contains_ignoring_case(text, key), F.lit(value)) for key, value in mapping.items()]
    return F.coalesce(*[F.when(found, value) for found, value in rungs])
