"""The published values, from the reconstructed log and from published aggregates."""

from __future__ import annotations

import pytest

import published as pub
import reconstruction
from footfall.operators import experiment, funnel, reports, retention, segments
from footfall.operators.users import user_facts, user_flags
from footfall.plans import analyses
from footfall.sources import written_table
from footfall.schema import AB_RESULTS, SEGMENT_CONVERSION

CLOSE = {"rel": 1e-12, "abs": 0.0}


@pytest.fixture(scope="module")
def log(spark):
    events, users, products = reconstruction.build()
    return (
        spark.createDataFrame(
            events,
            "user_id STRING, product_id STRING, event_type STRING, "
            "event_timestamp TIMESTAMP_NTZ",
        ).repartition(8),
        spark.createDataFrame(users, "user_id STRING, gender STRING"),
        spark.createDataFrame(products, "product_id STRING, category STRING"),
    )


@pytest.fixture(scope="module")
def facts(log, tmp_path_factory):
    return written_table(user_facts(log[0]), "facts", str(tmp_path_factory.mktemp("reconstructed")))


def test_funnel(log):
    tables = analyses.build_funnel(log[0])
    assert [tuple(r) for r in tables.stages.collect()] == list(pub.STAGES.items())
    rates = {r.metric: (r.rate, r.rate_pct) for r in tables.rates.collect()}
    assert list(rates) == list(pub.RATES)
    for name, (rate, pct) in pub.RATES.items():
        assert rates[name][0] == pytest.approx(rate, **CLOSE)
        assert rates[name][1] == pct
    long = [(r.stage, r.users, r.metric, r.rate_pct) for r in tables.long.collect()]
    assert long == [
        (stage, users, metric, pct)
        for stage, users in pub.STAGES.items()
        for metric, (_, pct) in pub.RATES.items()
    ]


def test_tracking_gaps(log):
    gaps = funnel.tracking_gaps(user_flags(log[0])).first()
    assert gaps.users_without_view == pub.VIEWLESS
    assert gaps.purchase_users_without_cart == pub.PURCHASE_WITHOUT_CART
    assert gaps.cart_and_purchase_users == pub.CART_AND_PURCHASE
    assert gaps.looser_rate_pct == 46.9


def test_largest_leak(log):
    leaks = funnel.funnel_leaks(user_flags(log[0])).collect()
    assert [(r.stage, r.largest_leak) for r in leaks] == [
        ("view", False), ("cart", False), ("purchase", True),
    ]
    assert [r.lost_users for r in leaks] == [None, 2967, 3713]


def test_cohorts(facts):
    rows = retention.cohort_retention(facts).collect()
    assert [r.cohort_month for r in rows] == list(pub.COHORTS)
    for row in rows:
        users, active, rate, pct = pub.COHORTS[row.cohort_month]
        assert (row.cohort_users, row.week1_users) == (users, active)
        assert row.week1_retention == pytest.approx(rate, **CLOSE)
        assert row.week1_retention_pct == pct
    overall = retention.overall_retention(retention.cohort_retention(facts)).first()
    assert (overall.cohort_users, overall.week1_users) == (9995, 772)
    assert overall.week1_retention_pct == pub.OVERALL_RETENTION_PCT


def test_segments(log):
    rows = analyses.build_segment_conversion(*log).collect()
    expected = [("gender", k, *v) for k, v in pub.GENDERS.items()] + [
        ("primary_cart_category", k, *v) for k, v in pub.CATEGORIES.items()
    ]
    assert [tuple(r)[:4] + (r[5],) for r in rows] == [e[:4] + (e[5],) for e in expected]
    for row, (*_, rate, _pct) in zip(rows, expected):
        assert row.cart_to_purchase_conversion == pytest.approx(rate, **CLOSE)


def test_segment_spread_and_top(spark):
    rows = [("gender", k, *v) for k, v in pub.GENDERS.items()]
    rows += [("primary_cart_category", k, *v) for k, v in pub.CATEGORIES.items()]
    table = spark.createDataFrame(rows, SEGMENT_CONVERSION)
    spread = {r.segment_type: r.spread_pp for r in segments.segment_spread(table).collect()}
    assert spread == {"gender": 1.51, "primary_cart_category": 3.82}
    top = [r.segment_value for r in segments.top_segments(table, 3).collect()]
    assert top == ["Books", "Toys", "Sports"]
    shown = reports.report_top_segments(table).collect()
    assert tuple(shown[0]) == ("Books", "698", "34.67%")
    assert len(shown) == 10
    worst = reports.report_segments(table, "primary_cart_category").first()
    assert tuple(worst) == ("Automotive", 671, 207, 30.85)
    labels = [tuple(r) for r in reports.report_segment_types(table).collect()]
    assert labels == [
        ("gender", "Gender"), ("primary_cart_category", "Primary Cart Category"),
    ]


def test_experiment(facts):
    tables = analyses.experiment_tables(facts)
    results = tables.results.collect()
    assert [r.variant for r in results] == list(pub.VARIANTS)
    for row in results:
        users, wins, rate, pct, _, kept, kept_pct = pub.VARIANTS[row.variant]
        assert (row.total_users, row.success_users) == (users, wins)
        assert row.conversion_rate == pytest.approx(rate, **CLOSE)
        assert row.conversion_rate_pct == pct
        assert row.week1_retention_rate == pytest.approx(kept, **CLOSE)
        assert row.week1_retention_rate_pct == kept_pct
    check_summary(tables.summary.first())
    assert tables.assignments.count() == pub.STAGES["cart"]


def test_summary_from_published_results(spark):
    rows = [
        ("checkout_optimization", variant, users, wins, rate, pct, kept, kept_pct, 0.0, 0.0)
        for variant, (users, wins, rate, pct, _, kept, kept_pct) in pub.VARIANTS.items()
    ]
    results = spark.createDataFrame(rows, AB_RESULTS)
    summary = experiment.ab_summary(results)
    check_summary(summary.first())
    assert tuple(reports.report_lift(summary).first()) == (
        "Lift (absolute): -0.02 percentage points", "p-value (two-sided): 0.898",
    )
    assert tuple(reports.report_ab_headline(results).first()) == ("0.54%", "0.52%")


def check_summary(row):
    assert row.experiment_name == "checkout_optimization"
    assert (row.control_variant, row.treatment_variant) == ("A_control", "B_treatment")
    for name, value in pub.SUMMARY.items():
        tolerance = 1e-10 if name in ("z_stat", "lift_abs", "lift_abs_pct_points", "lift_rel") else 1e-12
        assert row[name] == pytest.approx(value, rel=tolerance, abs=0.0)


def test_kpis(facts):
    shown = reports.report_kpis(reports.kpis(facts)).first()
    assert tuple(shown) == ("9,961", "6,994", "3,281", "33.07%", "7.72%", "6,994")


def test_totals_agree(log, facts):
    events, users, products = log
    segment_rows = analyses.segment_table(facts, events, users, products).collect()
    by_type = {}
    for row in segment_rows:
        total = by_type.setdefault(row.segment_type, [0, 0])
        total[0] += row.cart_users
        total[1] += row.purchased
    assert by_type == {
        "gender": [pub.STAGES["cart"], pub.CART_AND_PURCHASE],
        "primary_cart_category": [pub.STAGES["cart"], pub.CART_AND_PURCHASE],
    }


def test_report_rates(log):
    rates = funnel.funnel_rates(user_flags(log[0]))
    assert [tuple(r) for r in reports.report_rates(rates).collect()] == [
        ("View → Cart", "70.21%"),
        ("Strict Cart → Purchase", "33.07%"),
        ("View → Purchase (Overall)", "32.94%"),
    ]
    assert [r.key_metric for r in reports.report_key_metrics(rates).collect()] == [
        "View To Cart: 70.21%",
        "Cart To Purchase Strict: 33.07%",
        "View To Purchase Overall: 32.94%",
    ]
    stages = reports.report_stages(funnel.funnel_stages(user_flags(log[0]))).collect()
    assert [tuple(r) for r in stages] == [
        ("View", 9961, "9,961"), ("Cart", 6994, "6,994"), ("Purchase", 3281, "3,281"),
    ]
