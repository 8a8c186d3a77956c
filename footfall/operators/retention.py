"""Week-1 retention of cohorts of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions.rates import percent, ratio
from footfall.functions.times import cohort_label


def cohort_retention(facts: DataFrame, grain: str = "month") -> DataFrame:
    """Retention per period of the users' first event, by ``month`` or by ``day``.

    The period column is ``cohort_month`` or ``cohort_date``. Users none of whose events
    has a timestamp belong to no cohort.
    """
    name = "cohort_month" if grain == "month" else "cohort_date"
    cohorts = (
        facts.where(F.col("first_event_ts").isNotNull())
        .groupBy(cohort_label(F.col("first_event_ts"), grain).alias(name))
        .agg(
            F.count("*").alias("cohort_users"),
            F.count_if("week1_active").alias("week1_users"),
        )
    )
    return with_retention_rates(cohorts).orderBy(name)


def with_retention_rates(cohorts: DataFrame) -> DataFrame:
    return cohorts.withColumn(
        "week1_retention", ratio(F.col("week1_users"), F.col("cohort_users"))
    ).withColumn("week1_retention_pct", percent(F.col("week1_retention")))


def overall_retention(cohorts: DataFrame) -> DataFrame:
    """All cohorts in one row, as a ratio of sums (not a mean of the cohorts' rates)."""
    return with_retention_rates(
        cohorts.agg(
            F.sum("cohort_users").alias("cohort_users"),
            F.sum("week1_users").alias("week1_users"),
        )
    )


def retention_by_activation(facts: DataFrame) -> DataFrame:
    """Week-1 retention of the users activated on their first day, and of the others."""
    return with_retention_rates(
        facts.where(F.col("first_event_ts").isNotNull())
        .groupBy("activated")
        .agg(
            F.count("*").alias("cohort_users"),
            F.count_if("week1_active").alias("week1_users"),
        )
    )
