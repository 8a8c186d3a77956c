"""Totals that must agree across analyses, on the given tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import table_dir
from footfall.operators import experiment, funnel, retention
from footfall.operators.users import user_facts
from footfall.plans import analyses, bindings
from footfall.sources import written_table


@pytest.fixture(scope="module")
def order_log(spark, tmp_path_factory):
    tables = bindings.order_history(spark, table_dir("0.01"))
    return tables, written_table(
        user_facts(tables.events), "facts", str(tmp_path_factory.mktemp("orders"))
    )


@pytest.fixture(scope="module")
def click_facts(spark, tmp_path_factory):
    events = bindings.clickstream(spark, table_dir("0.01"))
    return events, written_table(
        user_facts(events), "facts", str(tmp_path_factory.mktemp("clicks"))
    )


def test_segments_and_variants_cover_the_cart_users(order_log):
    tables, facts = order_log
    stages = {r.stage: r.users for r in funnel.funnel_stages(facts).collect()}
    converted = facts.where("has_cart and has_purchase").count()
    segments = analyses.segment_table(
        facts, tables.events, tables.users, tables.products, "mktsegment"
    )
    for row in segments.groupBy("segment_type").agg(
        F.sum("cart_users").alias("users"), F.sum("purchased").alias("bought")
    ).collect():
        assert (row.users, row.bought) == (stages["cart"], converted)
    results = experiment.ab_results(facts).collect()
    assert sum(r.total_users for r in results) == stages["cart"]
    assert experiment.assignments(facts).count() == stages["cart"]


@pytest.mark.parametrize("source", ["order_log", "click_facts"])
def test_cohorts_cover_the_users(request, source):
    _, facts = request.getfixturevalue(source)
    for grain in ("month", "day"):
        cohorts = retention.cohort_retention(facts, grain)
        overall = retention.overall_retention(cohorts).first()
        assert overall.cohort_users == facts.count()
        assert overall.week1_users == facts.where("week1_active").count()
    split = retention.retention_by_activation(facts).collect()
    assert sum(r.cohort_users for r in split) == facts.count()


@pytest.mark.parametrize("source", ["order_log", "click_facts"])
def test_no_figure_is_trivial(request, source):
    """A wrong operator could hide behind rates of all 0 or all 1."""
    _, facts = request.getfixturevalue(source)
    for flag in ("has_view", "has_cart", "has_purchase", "week1_active",
                 "purchase_within_7d", "activated"):
        assert 0 < facts.where(flag).count() < facts.count()


def test_facts_do_not_depend_on_the_partitioning(click_facts):
    events, facts = click_facts
    again = user_facts(events.repartition(13, "event_timestamp"))
    assert again.exceptAll(facts).isEmpty() and facts.exceptAll(again).isEmpty()
