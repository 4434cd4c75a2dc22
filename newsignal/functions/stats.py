"""Averages and deviations from sums, so that one partial aggregate serves every level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(total: Column, n: Column, digits: int | None = None) -> Column:
    """``total / n``; NULL for ``n = 0``. With ``digits``, divided as decimals and rounded half up."""
    if digits is None:
        return F.try_divide(total.cast("double"), n.cast("double"))
    exact = F.try_divide(total.cast("decimal(28,8)"), n.cast("decimal(13,0)"))
    return F.round(exact, digits).cast("double")


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def population_stddev(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from count, sum and sum of squares of a decimal(.,4) column.

    The numerator n·Σx² - (Σx)² is exact in decimal(38,8) up to 10^13 rows, so equal values give
    exactly 0 and the result does not depend on the order of the partial sums.
    """
    count = n.cast("decimal(13,0)")
    mean_part = total.cast("decimal(18,4)")
    spread = count * squares.cast("decimal(24,8)") - mean_part * mean_part
    return F.try_divide(F.sqrt(spread.cast("double")), n.cast("double"))
