"""Ordered threshold ladders as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_ladder(guard: Column, rungs: Sequence[tuple[str, int | None]]) -> Column:
    """Points of the first rung whose SQL predicate holds.

    Null when ``guard`` is null and when no rung matches; a rung may itself give null.
    """
    ladder = F.when(guard.isNull(), F.lit(None).cast("int"))
    for predicate, points in rungs:
        ladder = ladder.when(F.expr(predicate), F.lit(points).cast("int"))
    return ladder


def total_score(columns: Sequence[str]) -> Column:
    """Sum of components, a missing component counting as normal (zero)."""
    total = F.lit(0)
    for name in columns:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total
