"""The analyses under the column names and conventions of the SQL query library.

They differ from ``plans.analyses`` in the conventions only: rates are strict and NULL on
an empty denominator, cohorts are daily, users without an attribute form a segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.operators import experiment, retention
from footfall.operators.users import user_facts
from footfall.plans.analyses import build_segment_conversion
from footfall.schema import EXPERIMENT_NAME


def cohort_retention_week1(events: DataFrame) -> DataFrame:
    """Daily cohorts; the day is named ``cohort_month`` as in the library."""
    daily = retention.cohort_retention(user_facts(events), "day")
    return daily.select(
        F.col("cohort_date").alias("cohort_month"),
        "cohort_users",
        "week1_users",
        F.col("week1_retention").alias("week1_retention_rate"),
    )


def conversion_by_segment(
    events: DataFrame, users: DataFrame, products: DataFrame, attribute: str = "gender"
) -> DataFrame:
    segments = build_segment_conversion(events, users, products, attribute, keep_null=True)
    return segments.drop("cart_to_purchase_conversion_pct").withColumnRenamed(
        "purchased", "purchased_users"
    )


def ab_test_primary_and_guardrails(
    facts: DataFrame, experiment_name: str = EXPERIMENT_NAME
) -> DataFrame:
    """From ``user_facts``."""
    return experiment.ab_results(facts, experiment_name).select(
        "variant",
        "total_users",
        "success_users",
        "conversion_rate",
        "week1_retention_rate",
        "median_time_to_activation_hours",
    )
