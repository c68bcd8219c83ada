"""Numeric columns: exact rational rounding, sigmoid, finite guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def ratio_round(num, den, digits: int = 4, zero=0.0) -> Column:
    """``round(num / den, digits)`` computed exactly on integers, half-up.

    Metric values are ratios of counts; rounding them through a double can
    land on either side of a .5 edge depending on the engine.  Integer
    arithmetic on DECIMAL(38,0) is exact and identical everywhere.
    ``zero`` is returned when ``den`` is 0 (scikit-style ``zero_division``);
    pass ``None`` for NULL.
    """
    scale = 10 ** digits
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    q = F.call_function("div", n * F.lit(2 * scale) + d, d * F.lit(2))
    value = q.cast("double") / F.lit(float(scale))
    zero_col = F.lit(None).cast("double") if zero is None else F.lit(float(zero))
    return F.when(d == 0, zero_col).otherwise(value)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def finite_or_zero(arr) -> Column:
    """NaN / +-inf -> 0.0 per array element (NULL elements too)."""
    def fix(v):
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))),
                      F.lit(0.0)).otherwise(v.cast("double"))
    return F.transform(_c(arr), fix)
