"""Rounding and exact sums in primitive arithmetic, inside generated code.

Values count as decimals with eight places: every product of a price and a probability fits. Scaled to
whole hundred-millionths they are integers, so ties are real ties and sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

_PLACES = 8
_SCALE = 10.0 ** _PLACES


def _units(col: Column) -> Column:
    return F.rint(col.cast("double") * _SCALE)


def half_even(col: Column, digits: int = 2) -> Column:
    """Banker's rounding of the eight-place value; never a negative zero."""
    return F.rint(_units(col) / 10.0 ** (_PLACES - digits)) / 10.0 ** digits + F.lit(0.0)


def exact_sum(col: Column, window: WindowSpec | None = None) -> Column:
    """Sum that does not depend on how rows are partitioned; wide enough for any table. A value
    beyond 28 digits of hundred-millionths, or not finite, is left out like a null."""
    total = F.sum(_units(col).try_cast("decimal(28,0)"))
    return (total.over(window) if window else total).cast("double") / _SCALE


def exact_avg(col: Column) -> Column:
    """Mean of the non-null values over an exact sum; null for an empty group."""
    return F.try_divide(exact_sum(col), F.count(col))
