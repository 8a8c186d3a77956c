"""Guarded ratios and percentages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """``part / whole`` as a double; ``empty`` (NULL by default) where whole is 0.

    Both sides are cast first: dividing integers or decimals would give a decimal.
    """
    rate = F.try_divide(part.cast("double"), whole.cast("double"))
    return rate if empty is None else F.coalesce(rate, F.lit(float(empty)))


def percent(rate: Column, digits: int = 2) -> Column:
    """Rate as a percentage, rounded half to even."""
    return F.bround(rate * F.lit(100.0), digits)
