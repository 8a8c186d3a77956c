"""Normal distribution as a Column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_TERMS = 120  # enough for full double precision on 0 <= x <= 6
_MAX_X = 6.0  # 1 - erf(6) is 2e-17, below the resolution of 1 - p


def erf(x: Column) -> Column:
    """Error function for x >= 0.

    Series ``2/sqrt(pi) * exp(-x^2) * sum 2^n x^(2n+1) / (1*3*...*(2n+1))``: all its
    terms are positive, so nothing cancels.
    """
    x = F.least(x, F.lit(_MAX_X))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add_term(acc: Column, n: Column) -> Column:
        term = acc["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n + F.lit(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.sequence(F.lit(1), F.lit(_TERMS))
    series = F.aggregate(steps, start, add_term, lambda acc: acc["total"])
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * series


def two_sided_p(z: Column) -> Column:
    """``2 * (1 - cdf(|z|))`` of the standard normal; NULL where z is NULL."""
    upper = F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0)))
    # least() and greatest() skip NULLs, so a missing z has to be kept out of them.
    return F.when(z.isNotNull(), F.greatest(upper, F.lit(0.0)))
