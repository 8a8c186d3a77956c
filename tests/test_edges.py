"""Hand-made events for each decided corner of the metric definitions."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.rates import percent
from footfall.operators import experiment, funnel, quality, retention, segments
from footfall.operators.users import funnel_users, user_facts, user_flags

T0 = datetime(2024, 3, 1, 12)
EVENTS = "user_id STRING, product_id STRING, event_type STRING, event_timestamp TIMESTAMP_NTZ"


def make(spark, rows):
    """Rows of (user, type, offset from T0 or None[, product])."""
    return spark.createDataFrame(
        [
            (r[0], r[3] if len(r) > 3 else None, r[1], None if r[2] is None else T0 + r[2])
            for r in rows
        ],
        EVENTS,
    )


def h(n):
    return timedelta(hours=n)


def d(n):
    return timedelta(days=n)


TICK = timedelta(microseconds=1)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("early_purchase", "purchase", h(0)), ("early_purchase", "cart", h(1)),
        ("same_instant", "cart", h(0)), ("same_instant", "purchase", h(0)),
        ("just_inside_7d", "cart", h(0)), ("just_inside_7d", "purchase", d(7) - TICK),
        ("at_7d", "cart", h(0)), ("at_7d", "purchase", d(7)),
        ("at_14d", "view", h(0)), ("at_14d", "view", d(14)),
        ("before_14d", "view", h(0)), ("before_14d", "view", d(14) - TICK),
        ("before_7d", "view", h(0)), ("before_7d", "view", d(7) - TICK),
        ("around_week", "view", h(0)), ("around_week", "view", d(7) - TICK),
        ("around_week", "view", d(14)),
        ("at_24h", "view", h(0)), ("at_24h", "purchase", h(24)),
        ("before_24h", "view", h(0)), ("before_24h", "purchase", h(24) - TICK),
        ("second_purchase", "cart", h(5)), ("second_purchase", "purchase", h(0)),
        ("second_purchase", "purchase", h(6)),
        ("only_wish", "wishlist", h(0)),
        ("no_time", "cart", None),
        ("some_time", "cart", None), ("some_time", "purchase", h(2)),
        (None, "view", h(0)), ("untyped", None, h(0)),
    ]
    return {r.user_id: r for r in user_facts(make(spark, rows)).collect()}


def test_null_users_are_left_out(facts):
    assert None not in facts


@pytest.mark.parametrize("user, bought", [
    ("early_purchase", False), ("same_instant", True), ("just_inside_7d", True),
    ("at_7d", False), ("second_purchase", True), ("some_time", False),
])
def test_attribution_window_is_half_open(facts, user, bought):
    assert facts[user].has_cart and facts[user].has_purchase
    assert facts[user].purchase_within_7d is bought


@pytest.mark.parametrize("user, active", [
    ("at_7d", True), ("just_inside_7d", False), ("at_14d", False), ("before_14d", True),
    ("before_7d", False), ("around_week", False), ("only_wish", False), ("no_time", False),
])
def test_retention_window_is_half_open(facts, user, active):
    assert facts[user].week1_active is active


@pytest.mark.parametrize("user, hours", [
    ("early_purchase", 0.0), ("same_instant", 0.0), ("at_24h", None),
    ("before_24h", 24 - 1 / 3.6e9), ("second_purchase", 0.0), ("at_7d", None),
])
def test_activation(facts, user, hours):
    assert facts[user].time_to_activation_hours == pytest.approx(hours, abs=1e-12)
    assert facts[user].activated is (hours is not None)


def test_users_without_types_or_times_are_kept(facts):
    assert facts["only_wish"].first_event_ts == T0
    assert not (facts["only_wish"].has_view or facts["only_wish"].has_cart)
    assert facts["no_time"].has_cart and facts["no_time"].first_event_ts is None
    assert facts["some_time"].first_cart_ts is None
    assert facts["untyped"].first_event_ts == T0


def test_users_without_a_time_have_no_cohort(spark):
    events = make(spark, [("a", "view", None), ("b", "view", h(0)), ("b", "view", None)])
    rows = retention.cohort_retention(user_facts(events)).collect()
    assert [(r.cohort_month, r.cohort_users) for r in rows] == [("2024-03", 1)]
    assert funnel.funnel_stages(funnel_users(events)).first().users == 2


def test_loose_and_strict_rates(spark):
    events = make(spark, [
        ("a", "view", h(0)), ("b", "view", h(0)), ("b", "cart", h(0)), ("c", "cart", h(0)),
        ("c", "purchase", h(0)), ("d", "wishlist", h(0)),
    ])
    users = funnel_users(events)
    loose = [r.rate for r in funnel.funnel_rates(users).collect()]
    strict = [r.rate for r in funnel.funnel_rates(users, "strict").collect()]
    assert loose == [1.0, 0.5, 0.5]
    assert strict == [0.5, 0.5, 0.0]
    assert list(funnel.funnel_wide(users).first())[3:] == strict
    with pytest.raises(ValueError):
        funnel.funnel_rates(users, "fuzzy")


def test_empty_log(spark):
    events = make(spark, [])
    users = funnel_users(events)
    assert [r.users for r in funnel.funnel_stages(users).collect()] == [0, 0, 0]
    assert [r.rate for r in funnel.funnel_rates(users).collect()] == [0.0, 0.0, 0.0]
    assert [r.rate for r in funnel.funnel_rates(users, "strict").collect()] == [None] * 3
    facts = user_facts(events)
    assert retention.cohort_retention(facts).count() == 0
    assert experiment.ab_results(facts).count() == 0
    summary = experiment.ab_summary(experiment.ab_results(facts)).first()
    assert summary.z_stat is None and summary.control_conversion_rate is None


def test_missing_keys_and_unexpected_types(spark):
    events = make(spark, [
        (None, "view", h(0)), ("", "view", h(0)), ("  ", "view", h(0)), ("a", None, h(0)),
        ("a", " ", h(0)), ("a", "refund", None), ("a", "refund", h(0)), ("a", "wishlist", h(0)),
    ])
    assert tuple(quality.missing_keys(events).first()) == (3, 2, 1)
    found = {r.event_type: r.cnt for r in quality.unexpected_event_types(events).collect()}
    assert found == {" ": 1, "refund": 2}


def test_bad_timestamps(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:00",), ("2024-01-01T10:00:00.5",), ("2024-01-01",), ("junk",),
         (None,), ("2024-13-01",)],
        "event_timestamp STRING",
    )
    assert tuple(quality.bad_timestamps(raw).first()) == (6, 1, 2)


PRODUCTS = [("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", None)]


def primary(spark, rows):
    products = spark.createDataFrame(PRODUCTS, "product_id STRING, category STRING")
    found = segments.primary_category(make(spark, rows), products).collect()
    return {r.user_id: r.primary_cart_category for r in found}


def test_primary_category(spark):
    assert primary(spark, [
        ("most", "cart", h(3), "p2"), ("most", "cart", h(1), "p1"), ("most", "cart", h(4), "p2"),
        ("tie", "cart", h(1), "p2"), ("tie", "cart", h(2), "p1"), ("tie", "cart", h(3), "p1"),
        ("tie", "cart", h(4), "p2"),
        ("same_time", "cart", h(1), "p3"), ("same_time", "cart", h(1), "p2"),
        ("unknown", "cart", h(1), "zz"), ("unknown", "cart", h(2), None),
        ("unlabelled", "cart", h(1), "p4"),
        ("mixed", "cart", h(1), "zz"), ("mixed", "cart", h(2), "zz"), ("mixed", "cart", h(3), "p1"),
        ("viewer", "view", h(1), "p1"),
        (None, "cart", h(1), "p1"),
    ]) == {"most": "B", "tie": "B", "same_time": "B", "mixed": "A"}


def test_attribute_segments(spark):
    events = make(spark, [
        ("twice", "cart", h(0)), ("twice", "purchase", h(0)), ("none", "cart", h(0)),
        ("listed_again", "cart", h(0)), ("browser", "view", h(0)), ("absent", "cart", h(0)),
    ])
    users = spark.createDataFrame(
        [("twice", "x"), ("twice", "y"), ("none", None), ("listed_again", "x"),
         ("listed_again", "x"), ("browser", "x")],
        "user_id STRING, gender STRING",
    )
    flags = user_flags(events)

    def counts(keep_null):
        found = segments.segment_by_attribute(flags, users, keep_null=keep_null).collect()
        return {r.segment_value: (r.cart_users, r.purchased) for r in found}

    assert counts(False) == {"x": (2, 1), "y": (1, 1)}
    assert counts(True) == {"x": (2, 1), "y": (1, 1), None: (1, 0)}


def test_no_variance_and_missing_variant(spark):
    schema = "variant STRING, total_users LONG, success_users LONG"

    def summary(*rows):
        return experiment.ab_summary(spark.createDataFrame(rows, schema)).first()

    nobody = summary(("A_control", 10, 0), ("B_treatment", 10, 0))
    assert (nobody.z_stat, nobody.p_value_two_sided, nobody.lift_rel) == (None, None, None)
    assert nobody.lift_abs == 0.0
    everybody = summary(("A_control", 10, 10), ("B_treatment", 10, 10))
    assert (everybody.z_stat, everybody.lift_rel) == (None, 0.0)
    alone = summary(("A_control", 10, 5))
    assert alone.control_conversion_rate == 0.5
    assert alone.treatment_conversion_rate is None and alone.p_value_two_sided is None


def test_nobody_activated(spark):
    events = make(spark, [("a", "cart", h(0)), ("b", "cart", h(0)), ("c", "cart", h(0))])
    for row in experiment.ab_results(user_facts(events)).collect():
        assert row.median_time_to_activation_hours is None
        assert row.mean_time_to_activation_hours is None
        assert row.conversion_rate == 0.0


def test_percentages_round_half_to_even(spark):
    rates = spark.createDataFrame([(13 / 160,), (0.08145,), (0.02675,)], "rate DOUBLE")
    assert [r[0] for r in rates.select(percent(F.col("rate"))).collect()] == [8.12, 8.14, 2.68]


def test_cohort_grain(spark):
    facts = user_facts(make(spark, [("a", "view", h(0)), ("b", "view", d(40))]))
    assert [r.cohort_date for r in retention.cohort_retention(facts, "day").collect()] == [
        "2024-03-01", "2024-04-10",
    ]
    with pytest.raises(ValueError):
        retention.cohort_retention(facts, "week")


def test_windows_ignore_daylight_saving(spark):
    """Seven days are 168 hours, in whatever zone the session is."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = datetime(2024, 3, 9, 12)  # clocks change on 2024-03-10
        events = spark.createDataFrame(
            [("a", None, "cart", start), ("a", None, "purchase", start + h(168) - TICK),
             ("b", None, "cart", start), ("b", None, "purchase", start + h(168)),
             ("c", None, "cart", start), ("c", None, "purchase", start + h(20))],
            EVENTS,
        )
        facts = {r.user_id: r for r in user_facts(events).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [facts[u].purchase_within_7d for u in "abc"] == [True, False, True]
    assert [facts[u].week1_active for u in "abc"] == [False, True, False]
    assert facts["c"].time_to_activation_hours == 20.0
