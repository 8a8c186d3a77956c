"""Distinct users of any range of days against exact counts."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import sketches
from footfall.operators.funnel import funnel_wide
from footfall.operators.users import funnel_users
from test_brute_force import EVENTS
from test_plans import exchanges, plan

T0 = datetime(2024, 1, 1)
TYPES = ["view", "cart", "purchase"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(40_000):
        kind = rng.choices(TYPES, (8, 3, 1))[0]
        out.append((f"u{rng.randrange(15_000)}", None, kind, T0 + timedelta(hours=rng.randrange(24 * 20))))
    out += [(None, None, "view", T0), ("u1", None, None, T0), ("u1", None, "view", None)]
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS).repartition(6).cache()


def exact(rows, first, last):
    out = {}
    for user, _, kind, when in rows:
        if user and kind and when and first <= when.date() <= last:
            n, users = out.setdefault(kind, (0, set()))
            out[kind] = (n + 1, users)
            users.add(user)
    return out


@pytest.mark.parametrize("kind", ["hll", "theta"])
@pytest.mark.parametrize("lg_k", [10, 14])
def test_ranges_are_as_near_as_stated(events, rows, kind, lg_k):
    daily = sketches.daily_sketches(events, kind, lg_k).cache()
    share = sketches.relative_error(kind, lg_k, sigmas=4)
    assert share == pytest.approx(4 * (1.04 if kind == "hll" else 1) / 2 ** (lg_k / 2))
    for first, last in ((1, 20), (3, 3), (5, 12)):
        days = date(2024, 1, first), date(2024, 1, last)
        expected = exact(rows, *days)
        found = {r.event_type: r for r in sketches.users_in_range(daily, *days, kind, lg_k).collect()}
        assert found.keys() == expected.keys()
        for name, (n, users) in expected.items():
            assert found[name].events == n
            assert abs(found[name].users - len(users)) <= max(1, share * len(users))


def test_parts_of_a_log_merge_to_the_whole(events, rows):
    for kind in ("hll", "theta"):
        parts = [sketches.daily_sketches(events.where(F.col("event_type") != "cart"), kind),
                 sketches.daily_sketches(events.where(F.hour("event_timestamp") < 9), kind),
                 sketches.daily_sketches(events, kind)]
        once = sketches.merge_days(sketches.merge_days(parts[0], parts[1], kind), parts[2], kind)
        whole = {r.event_type: r.users for r in sketches.users_in_range(parts[2], kind=kind).collect()}
        assert {r.event_type: r.users for r in sketches.users_in_range(once, kind=kind).collect()} == pytest.approx(whole, rel=0.02)


def test_rolling_ranges(events, rows):
    daily = sketches.daily_sketches(events, "theta", 16)
    found = {(r.event_date, r.event_type): r.users for r in sketches.rolling_users(daily, 5, "theta", 16).collect()}
    days = [date(2024, 1, d) for d in range(1, 21)]
    expected = {}
    for day in days:
        for kind, (_, users) in exact(rows, day - timedelta(days=4), day).items():
            expected[day, kind] = len(users)
    assert found == expected  # exact below 2 ** 16 users
    with pytest.raises(ValueError):
        sketches.rolling_users(daily, 0)


def test_funnel_of_a_range(events):
    daily = sketches.daily_sketches(events, "theta", 16)
    first, last = date(2024, 1, 4), date(2024, 1, 9)
    of_days = events.where(F.to_date("event_timestamp").between(first, last))
    assert sketches.funnel_in_range(daily, first, last, lg_k=16).first() == funnel_wide(funnel_users(of_days)).first()
    nothing = sketches.funnel_in_range(daily, date(2030, 1, 1), lg_k=16).first()
    assert tuple(nothing) == (0, 0, 0, None, None, None)
    rough = sketches.funnel_in_range(sketches.daily_sketches(events, "theta", 10), lg_k=10).first()
    whole = funnel_wide(funnel_users(events)).first()
    assert rough.view_users == pytest.approx(whole.view_users, rel=sketches.relative_error("theta", 10, 4))


def test_sketches_are_made_before_the_shuffle(events):
    text = plan(sketches.daily_sketches(events))
    assert len(exchanges(text)) == 1 and "partial_hll_sketch_agg" in text
    text = plan(sketches.rolling_users(sketches.daily_sketches(events)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_kinds(events, spark):
    with pytest.raises(ValueError, match="kind"):
        sketches.daily_sketches(events, "bloom")
    empty = sketches.daily_sketches(spark.createDataFrame([], EVENTS))
    assert empty.count() == 0 and sketches.users_in_range(empty).count() == 0
