"""Distinct users over any range of days, from sketches per day and event type.

Distinct counts don't add up: the users of a week aren't the sum of its days' users. Sketches do.
The log is read once, into one small row per day and type, which part logs of a day can be
merged into; every range is then a union of a few rows.

* HyperLogLog sketches (``hll``) count; 2 ** lg_k bytes at most.
* Theta sketches (``theta``) also count users of two types at once, which funnel rates need;
  8 * 2 ** lg_k bytes at most. They are exact up to 2 ** lg_k users.

``relative_error`` tells how far an estimate may be off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.rates import ratio
from footfall.schema import FUNNEL_STEPS


class _Kind(NamedTuple):
    made: Callable[[Column, int], Column]
    union: Callable[[Column, int], Column]
    estimate: Callable[[Column], Column]
    #: Relative standard error times the square root of 2 ** lg_k.
    spread: float


_KINDS = {
    "hll": _Kind(
        F.hll_sketch_agg, lambda c, _: F.hll_union_agg(c, False), F.hll_sketch_estimate, 1.04
    ),
    "theta": _Kind(F.theta_sketch_agg, F.theta_union_agg, F.theta_sketch_estimate, 1.0),
}


def _kind(name: str) -> _Kind:
    if name not in _KINDS:
        raise ValueError(f"kind must be one of {sorted(_KINDS)}, not {name!r}")
    return _KINDS[name]


def relative_error(kind: str = "hll", lg_k: int = 12, sigmas: float = 3.0) -> float:
    """Share by which a count is off at most, with the probability of so many sigmas."""
    return sigmas * _kind(kind).spread / math.sqrt(1 << lg_k)


def daily_sketches(events: DataFrame, kind: str = "hll", lg_k: int = 12) -> DataFrame:
    """``event_date, event_type, events, users``: the rows of each day and type, and a sketch of
    their users.

    Rows without user, type or timestamp are left out. Sketches are made by the map tasks, so a
    day that holds a large share of the log is one small row per task.
    """
    known = events.where(
        F.col("user_id").isNotNull()
        & F.col("event_type").isNotNull()
        & F.col("event_timestamp").isNotNull()
    )
    day = F.to_date("event_timestamp").alias("event_date")
    return known.groupBy(day, "event_type").agg(
        F.count("*").alias("events"), _kind(kind).made(F.col("user_id"), lg_k).alias("users")
    )


def merge_days(daily: DataFrame, more: DataFrame, kind: str = "hll", lg_k: int = 12) -> DataFrame:
    """``daily_sketches`` of a log from those of its parts, which may have days in common."""
    return daily.unionByName(more).groupBy("event_date", "event_type").agg(
        F.sum("events").alias("events"), _kind(kind).union(F.col("users"), lg_k).alias("users")
    )


def _between(daily: DataFrame, first: date | None, last: date | None) -> DataFrame:
    if first is not None:
        daily = daily.where(F.col("event_date") >= F.lit(first))
    return daily if last is None else daily.where(F.col("event_date") <= F.lit(last))


def users_in_range(
    daily: DataFrame,
    first: date | None = None,
    last: date | None = None,
    kind: str = "hll",
    lg_k: int = 12,
) -> DataFrame:
    """``event_type, events, users`` from day ``first`` to day ``last``, both included."""
    found = _kind(kind)
    return _between(daily, first, last).groupBy("event_type").agg(
        F.sum("events").alias("events"),
        found.estimate(found.union(F.col("users"), lg_k)).alias("users"),
    )


def rolling_users(daily: DataFrame, days: int = 7, kind: str = "hll", lg_k: int = 12) -> DataFrame:
    """``event_date, event_type, users``: users of the ``days`` days up to each day of the log.

    Every day's row goes to the ``days`` ranges it is in; no range reads raw events. Days without
    any event have no row, and neither have types without one in the range.
    """
    if days < 1:
        raise ValueError("a range has one day at least")
    found = _kind(kind)
    ends = F.sequence(F.col("event_date"), F.date_add("event_date", days - 1))
    spread = daily.select(F.explode(ends).alias("event_date"), "event_type", "users")
    of_log = daily.select("event_date").distinct()
    return (
        spread.join(of_log, "event_date", "left_semi")
        .groupBy("event_date", "event_type")
        .agg(found.estimate(found.union(F.col("users"), lg_k)).alias("users"))
    )


def funnel_in_range(
    daily: DataFrame,
    first: date | None = None,
    last: date | None = None,
    steps: Sequence[str] = FUNNEL_STEPS,
    lg_k: int = 12,
) -> DataFrame:
    """``funnel.funnel_wide`` of a range of days, from theta sketches."""
    a, b, c = steps
    of_step = [
        F.theta_union_agg(F.when(F.col("event_type") == step, F.col("users")), lg_k).alias(step)
        for step in steps
    ]
    rows = _between(daily, first, last).where(F.col("event_type").isin(*steps)).agg(*of_step)

    def users(*names: str) -> Column:
        sketch = F.col(names[0])
        for name in names[1:]:
            sketch = F.theta_intersection(sketch, F.col(name))
        return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0))

    return rows.select(
        users(a).alias(f"{a}_users"),
        users(b).alias(f"{b}_users"),
        users(c).alias(f"{c}_users"),
        ratio(users(a, b), users(a)).alias(f"{a}_to_{b}_conversion"),
        ratio(users(b, c), users(b)).alias(f"{b}_to_{c}_conversion_strict"),
        ratio(users(a, c), users(a)).alias(f"{a}_to_{c}_conversion_overall"),
    )
