"""Two-sided p-value of Student's t as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom from which t is taken as normal.
NORMAL_FROM = 1e7
_SHIFT = 8
#: Terms of the series of the logarithm of the gamma function, at odd powers of 1 / x.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _log_gamma(x: Column) -> Column:
    """Stirling's series above ``_SHIFT``, where five terms suffice, and the recurrence down to ``x``."""
    y = x + F.lit(float(_SHIFT))
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * i + 1)) for i, c in enumerate(_SERIES)), F.lit(0.0))
    above = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    return above - sum((F.ln(x + float(i)) for i in range(_SHIFT)), F.lit(0.0))


def _incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction from its tail, whose depth grows with the root of the larger parameter."""
    depth = F.lit(100) + 10 * F.floor(F.least(F.sqrt(F.greatest(a, b)), F.sqrt(F.lit(NORMAL_FROM)))).cast("int")

    def step(fraction: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.lit(1.0) + F.when(j % 2 == 1, odd).otherwise(even) / fraction

    fraction = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit(1.0), step)
    front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)
    return F.exp(front) / (a * fraction)


def t_p_value(t: str | Column, df: str | Column) -> Column:
    """P(|T| > |t|), the regularised incomplete beta at ``df / (df + t^2)`` with ``(df / 2, 1 / 2)``; null where it is not defined."""
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    t, df = t.cast("double"), df.cast("double")
    known = ~F.isnan(t) & (F.abs(t) < float("inf")) & ~F.isnan(df) & (df > 0) & (df < float("inf"))
    x, rest = df / (df + t * t), t * t / (df + t * t)
    a, half = df / 2, F.lit(0.5)
    exact = F.when(x < (a + 1) / (a + half + 2), _incomplete_beta(x, a, half)).otherwise(1 - _incomplete_beta(rest, half, a))
    return F.when(known, F.when(t == 0, 1.0).when(x == 0, 0.0).when(df > NORMAL_FROM, _normal(F.abs(t))).otherwise(exact))


def _normal(z: Column) -> Column:
    """P(|Z| > z): the series of the error function below 3, a continued fraction above."""
    near = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, n: 1 + s * z * z / (2 * n + 1).cast("double")
    )
    far = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), z, lambda s, n: z + n.cast("double") / s)
    density = F.exp(-z * z / 2) * math.sqrt(2 / math.pi)
    return F.when(z < 3, 1 - density * z * near).otherwise(density / far)
