"""The four analyses as one call each, from logical tables to result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from footfall.operators import experiment, funnel, retention, segments
from footfall.operators.users import funnel_users, user_facts
from footfall.schema import EXPERIMENT_NAME


@dataclass(frozen=True)
class FunnelTables:
    stages: DataFrame
    rates: DataFrame
    long: DataFrame


@dataclass(frozen=True)
class ExperimentTables:
    results: DataFrame
    summary: DataFrame
    assignments: DataFrame


def funnel_tables(users: DataFrame, rate_mode: str = "loose") -> FunnelTables:
    """From ``user_flags`` or ``user_facts``."""
    return FunnelTables(
        funnel.funnel_stages(users),
        funnel.funnel_rates(users, rate_mode),
        funnel.funnel_long(users),
    )


def build_funnel(
    events: DataFrame, rate_mode: str = "loose", order: str = "any"
) -> FunnelTables:
    """``order="time"`` counts users that took the steps in order."""
    return funnel_tables(funnel_users(events, order=order), rate_mode)


def build_cohort_retention_week1(events: DataFrame, grain: str = "month") -> DataFrame:
    return retention.cohort_retention(user_facts(events), grain)


def segment_table(
    users_flags: DataFrame,
    events: DataFrame,
    users: DataFrame,
    products: DataFrame,
    attribute: str = "gender",
    keep_null: bool = False,
) -> DataFrame:
    """Both segment types, from per-user flags that are already there."""
    return segments.segment_conversion(
        segments.segment_by_attribute(users_flags, users, attribute, keep_null),
        segments.segment_by_primary_category(
            users_flags, segments.primary_category(events, products)
        ),
    )


def build_segment_conversion(
    events: DataFrame,
    users: DataFrame,
    products: DataFrame,
    attribute: str = "gender",
    keep_null: bool = False,
) -> DataFrame:
    return segment_table(funnel_users(events), events, users, products, attribute, keep_null)


def experiment_tables(
    facts: DataFrame, experiment_name: str = EXPERIMENT_NAME
) -> ExperimentTables:
    """From ``user_facts``; each table computes it once, so pass a written table for all."""
    return ExperimentTables(
        experiment.ab_results(facts, experiment_name),
        experiment.ab_summary(experiment.ab_totals(facts, experiment_name), experiment_name),
        experiment.assignments(facts, experiment_name),
    )


def build_ab_test(events: DataFrame, experiment_name: str = EXPERIMENT_NAME) -> ExperimentTables:
    """Results, summary and assignments. Nothing runs before they are read."""
    return experiment_tables(user_facts(events), experiment_name)
