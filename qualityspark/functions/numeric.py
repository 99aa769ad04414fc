"""Numeric column expressions (F7-F14) and ANSI-safe arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def non_finite_to_null(c) -> Column:
    """NaN and +-inf become NULL (JSON-safe reports)."""
    c = _c(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero denominator (ANSI mode safe)."""
    return F.try_divide(_c(num), _c(den))


def clip(c, lower=None, upper=None) -> Column:
    """NULL-preserving clip; NULL bounds mean "no bound"."""
    c = _c(c)
    out = c
    if lower is not None:
        lo = _c(lower) if not isinstance(lower, (int, float)) else F.lit(float(lower))
        out = F.when(lo.isNotNull() & (out < lo), lo).otherwise(out)
    if upper is not None:
        hi = _c(upper) if not isinstance(upper, (int, float)) else F.lit(float(upper))
        out = F.when(hi.isNotNull() & (out > hi), hi).otherwise(out)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def log1p_clipped(c) -> Column:
    """log1p(clip(x, lower=0)); NULL stays NULL."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c)))


def month_dummies(month_col, months=range(1, 13), prefix="month_") -> list[Column]:
    m = _c(month_col)
    return [F.coalesce((m == k).cast("int"), F.lit(0)).alias(f"{prefix}{k}") for k in months]


def threshold_name(q) -> Column:
    return F.concat(F.lit("p"), F.round(_c(q) * 100).cast("int").cast("string"))


def round6(c, digits: int = 6) -> Column:
    return F.round(_c(c), digits)


#: nodes of the tail quadrature on each side of 0, and nodes per unit
TAIL_NODES, TAIL_STEP = 128, 32


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a Student t statistic: the density's integral beyond ``|t|`` over the
    one beyond 0, both by double-exponential quadrature, so no gamma function is needed.
    NULL for a missing statistic or degrees of freedom that are not positive, 0 for an infinite statistic."""
    def beyond(start: Column) -> Column:
        def add(total, i):
            x = i / F.lit(float(TAIL_STEP))
            step = F.exp(F.lit(math.pi / 2) * F.sinh(x))
            s = start + step
            return total + step * F.cosh(x) * F.exp(-(df + 1) / 2 * F.log1p(s * s / df))
        return F.aggregate(F.sequence(F.lit(-TAIL_NODES), F.lit(TAIL_NODES)), F.lit(0.0), add)

    p = beyond(F.abs(t)) / beyond(F.lit(0.0))
    known = t.isNotNull() & ~F.isnan(t) & (df > 0) & ~F.isnan(df)
    return F.when(known, F.when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(p))
