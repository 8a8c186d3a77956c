"""The funnel in order of time: random logs against plain Python, plans, skew, corners."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators.funnel import funnel_stages, funnel_wide
from footfall.operators.users import funnel_users, ordered_times, step_periods
from footfall.plans import analyses
from test_brute_force import EVENTS, random_log
from test_plans import exchanges, plan

STEPS = ("view", "cart", "purchase")
T0 = datetime(2024, 1, 1)


def plain_times(rows, steps):
    """user -> times, by walking through each user's events in order."""
    by_user = {}
    for user, _, kind, when in rows:
        if user is not None and when is not None and kind in steps:
            by_user.setdefault(user, []).append((when, steps.index(kind)))
    out = {}
    for user, events in by_user.items():
        times = []
        for place in range(len(steps)):
            since = times[-1] if times else datetime.min
            later = [t for t, k in events if k == place and t >= since]
            if not later:
                break
            times.append(min(later))
        if times:
            out[user] = (*times, *[None] * (len(steps) - len(times)))
    return out


def found_times(events, steps=STEPS, **options):
    rows = ordered_times(events, steps, **options).collect()
    assert len({r.user_id for r in rows}) == len(rows)
    return {r.user_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(1, 9))
def test_random_logs(spark, seed):
    rows = random_log(seed, users=80, span_days=6, per_user=14)
    events = spark.createDataFrame(rows, EVENTS).repartition(4)
    expected = plain_times(rows, STEPS)
    assert found_times(events) == expected
    assert found_times(events, period_days=5) == expected
    reached = [sum(t[k] is not None for t in expected.values()) for k in range(3)]
    assert [r.users for r in funnel_stages(funnel_users(events, order="time")).collect()] == reached
    wide = funnel_wide(funnel_users(events, order="time")).first()
    assert wide.view_to_cart_conversion == reached[1] / reached[0]


def test_other_steps(spark):
    rows = random_log(11, users=60, span_days=3, per_user=20)
    events = spark.createDataFrame(rows, EVENTS)
    for steps in (("cart",), ("wishlist", "view"), ("purchase", "wishlist", "cart", "view")):
        assert found_times(events, steps) == plain_times(rows, steps)
    with pytest.raises(ValueError, match="distinct"):
        ordered_times(events, ("view", "view"))
    with pytest.raises(ValueError, match="order"):
        funnel_users(events, order="type")


def at(*pairs):
    return [("u", None, kind, T0 + timedelta(minutes=m)) for kind, m in pairs]


@pytest.mark.parametrize("pairs, minutes", [
    ([("cart", 1), ("view", 2)], (2, None, None)),  # a cart before any view
    ([("cart", 1), ("view", 2), ("cart", 3)], (2, 3, None)),  # early and late in one period
    ([("view", 2), ("cart", 2), ("purchase", 2)], (2, 2, 2)),  # the same instant is in order
    ([("purchase", 3), ("view", 1), ("cart", 2)], (1, 2, 3)),
    ([("purchase", 1), ("view", 2), ("cart", 4), ("purchase", 3), ("purchase", 9)], (2, 4, 9)),
    ([("view", 5), ("cart", 1), ("cart", 3000)], (5, 3000, None)),  # found in a later period
    ([("view", 1439), ("cart", 1438), ("cart", 1440)], (1439, 1440, None)),  # over midnight
    ([("cart", 1), ("purchase", 2)], None),
])
def test_corners(spark, pairs, minutes):
    events = spark.createDataFrame(at(*pairs), EVENTS)
    expected = {} if minutes is None else {
        "u": tuple(None if m is None else T0 + timedelta(minutes=m) for m in minutes)
    }
    assert found_times(events) == expected


def test_rows_without_user_or_time_do_not_count(spark):
    rows = at(("view", 1)) + [(None, None, "cart", T0), ("u", None, "cart", None), ("u", None, None, T0)]
    assert found_times(spark.createDataFrame(rows, EVENTS)) == plain_times(rows, STEPS)
    assert found_times(spark.createDataFrame([], EVENTS)) == {}


def test_a_hot_user_is_a_row_per_period(spark):
    rows = [("hot", None, STEPS[i % 3], T0 + timedelta(seconds=30 * i)) for i in range(30_000)]
    periods = step_periods(spark.createDataFrame(rows, EVENTS))
    assert periods.count() <= 30_000 * 30 / 86_400 + 2
    assert found_times(spark.createDataFrame(rows, EVENTS)) == plain_times(rows, STEPS)


def test_events_are_rolled_up_before_they_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(random_log(3, users=200), EVENTS).write.parquet(path)
    text = plan(ordered_times(spark.read.parquet(path), ("view", "cart")))
    assert "In(event_type, [cart,view])" in text and "EqualTo(event_type,cart)" in text
    rolled = [x for x in exchanges(text) if "_groupingexpression" in x]
    assert rolled and "partial_min" in text
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_analysis(spark):
    rows = random_log(4, users=80, span_days=6)
    events = spark.createDataFrame(rows, EVENTS)
    tables = analyses.build_funnel(events, "strict", order="time")
    any_order = {r.stage: r.users for r in analyses.build_funnel(events).stages.collect()}
    in_order = {r.stage: r.users for r in tables.stages.collect()}
    assert in_order["view"] <= any_order["view"]  # a view without time has no place
    assert in_order["purchase"] < any_order["purchase"]
    assert tables.long.count() == 9
    assert tables.rates.where(F.col("rate") > 1).count() == 0
