"""Null-, zero- and non-finite-safe arithmetic.

Spark (ANSI on) raises on division by zero and sums of only NULLs are NULL;
the analyses expect a ratio guard and zero totals instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz_sum(c) -> Column:
    """``sum`` that yields 0 instead of NULL for empty / all-NULL input."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def safe_div(a, b) -> Column:
    """``a / b`` with NULL on a zero or NULL divisor (no ANSI error)."""
    return F.try_divide(_c(a), _c(b))


def guarded_ratio(num, den) -> Column:
    """``num / den`` when ``den > 0`` else NULL."""
    return F.when(_c(den) > 0, _c(num) / _c(den))


def finite_or_zero(x) -> Column:
    """NULL, NaN and +-Infinity become 0.0."""
    x = _c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nullif_empty(c) -> Column:
    """Empty string (no regex match) becomes NULL."""
    return F.nullif(_c(c), F.lit(""))


def clip_lower(c, lower=0) -> Column:
    """``clip(lower_bound=lower)``; NULL stays NULL."""
    c = _c(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))
