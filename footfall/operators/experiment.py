"""Experiment readout: assignment, attribution, guardrails and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.rates import percent, ratio
from footfall.functions.stats import two_sided_p
from footfall.functions.times import MICROS_PER_HOUR, micros_from_hours
from footfall.functions.variants import md5_variant
from footfall.operators.quantiles import grouped_median
from footfall.schema import (
    ACTIVATION_HOURS,
    CONTROL,
    EXPERIMENT_NAME,
    TREATMENT,
)


def population(facts: DataFrame) -> DataFrame:
    """The users an experiment runs on: those with at least one cart event."""
    return facts.where("has_cart")


def assign_variants(
    users: DataFrame,
    experiment_name: str = EXPERIMENT_NAME,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """Add ``variant`` and ``experiment_name``; a user always gets the same variant."""
    return users.withColumns({
        "variant": md5_variant(F.col("user_id"), control, treatment),
        "experiment_name": F.lit(experiment_name),
    })


def assignments(facts: DataFrame, experiment_name: str = EXPERIMENT_NAME) -> DataFrame:
    """``user_id, variant, experiment_name``, one row per user of the population."""
    return assign_variants(population(facts).select("user_id"), experiment_name)


def _members(facts: DataFrame, experiment_name: str) -> DataFrame:
    micros = micros_from_hours(F.col("time_to_activation_hours"))
    return assign_variants(population(facts), experiment_name).withColumn("micros", micros)


# Stands for no activation among whole microseconds.
NEVER = -1


def _cells(members: DataFrame, success: str) -> DataFrame:
    """Users per variant, success, week-1 activity and time to activation.

    All figures of the readout follow from these counts. Every column but the count is a
    key, so that each reader keeps the same plan and they share one shuffle.
    """
    return members.groupBy(
        "variant",
        F.coalesce(F.col(success), F.lit(False)).alias("success"),
        F.coalesce("week1_active", F.lit(False)).alias("week1"),
        F.coalesce("micros", F.lit(NEVER)).alias("micros"),
    ).agg(F.count("*").alias("n"))


def _totals(cells: DataFrame, experiment_name: str) -> DataFrame:
    activated = F.when(F.col("micros") != NEVER, F.col("n")).otherwise(0)
    # Whole microseconds add up exactly, in any order; 64 bits could overflow.
    micros = F.sum(F.col("micros").cast("decimal(20,0)") * activated)
    return cells.groupBy("variant").agg(
        F.lit(experiment_name).alias("experiment_name"),
        F.sum("n").alias("total_users"),
        F.sum(F.when(F.col("success"), F.col("n")).otherwise(0)).alias("success_users"),
        F.sum(F.when(F.col("week1"), F.col("n")).otherwise(0)).alias("week1_users"),
        (ratio(micros, F.sum(activated)) / MICROS_PER_HOUR)
        .alias("mean_time_to_activation_hours"),
    )


def ab_totals(
    facts: DataFrame,
    experiment_name: str = EXPERIMENT_NAME,
    success: str = "purchase_within_7d",
) -> DataFrame:
    """Counts and mean time to activation per variant, from one pass over ``facts``.

    Enough for ``ab_summary``.
    """
    return _totals(_cells(_members(facts, experiment_name), success), experiment_name)


def ab_results(
    facts: DataFrame,
    experiment_name: str = EXPERIMENT_NAME,
    success: str = "purchase_within_7d",
    activation_hours: int = ACTIVATION_HOURS,
    approx: bool = False,
) -> DataFrame:
    """Primary metric and guardrails per variant.

    The median time to activation is exact; ``approx`` takes ``percentile_approx`` (the
    lower of two middle values) instead, which saves the counting rounds. ``facts`` is
    computed once: all figures come from one table of counts.
    """
    members = _members(facts, experiment_name)
    cells = _cells(members, success)
    if approx:
        median = F.percentile_approx("micros", 0.5).cast("double") / MICROS_PER_HOUR
        medians = members.groupBy("variant").agg(median.alias("median_time_to_activation_hours"))
    else:
        weight = F.when(F.col("micros") != NEVER, F.col("n")).otherwise(0)
        middle = grouped_median(
            cells, "variant", "micros", weight, activation_hours * MICROS_PER_HOUR
        )
        median = (F.col("low") + F.col("high")).cast("double") / (2 * MICROS_PER_HOUR)
        medians = middle.select("variant", median.alias("median_time_to_activation_hours"))
    # One row per variant on both sides.
    results = _totals(cells, experiment_name).join(F.broadcast(medians), "variant", "left")
    conversion = ratio(F.col("success_users"), F.col("total_users"), 0.0)
    retention = ratio(F.col("week1_users"), F.col("total_users"), 0.0)
    return results.select(
        "experiment_name",
        "variant",
        "total_users",
        "success_users",
        conversion.alias("conversion_rate"),
        percent(conversion, 4).alias("conversion_rate_pct"),
        retention.alias("week1_retention_rate"),
        percent(retention, 4).alias("week1_retention_rate_pct"),
        "median_time_to_activation_hours",
        "mean_time_to_activation_hours",
    ).orderBy("variant")


def ab_summary(
    results: DataFrame,
    experiment_name: str = EXPERIMENT_NAME,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """One row: lift of the treatment and a two-sided two-proportion z-test.

    ``results`` is ``ab_results`` or ``ab_totals``.

    ``z_stat`` and ``p_value_two_sided`` are NULL where the pooled variance is zero, and
    so is every figure that needs a variant that is absent.
    """

    def of(variant: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)).cast("double"))

    pair = results.agg(
        of(control, "success_users").alias("x1"),
        of(control, "total_users").alias("n1"),
        of(treatment, "success_users").alias("x2"),
        of(treatment, "total_users").alias("n2"),
    )
    x1, n1, x2, n2, p1, p2 = (F.col(c) for c in ("x1", "n1", "x2", "n2", "p1", "p2"))
    pooled = ratio(x1 + x2, n1 + n2)
    one = F.lit(1.0)
    error = F.sqrt(pooled * (one - pooled) * (ratio(one, n1) + ratio(one, n2)))
    lift = p2 - p1
    return (
        pair.withColumns({"p1": ratio(x1, n1), "p2": ratio(x2, n2)})
        .withColumn("z_stat", ratio(lift, error))
        .select(
            F.lit(experiment_name).alias("experiment_name"),
            F.lit(control).alias("control_variant"),
            F.lit(treatment).alias("treatment_variant"),
            p1.alias("control_conversion_rate"),
            p2.alias("treatment_conversion_rate"),
            lift.alias("lift_abs"),
            (lift * 100.0).alias("lift_abs_pct_points"),
            ratio(lift, p1).alias("lift_rel"),
            "z_stat",
            two_sided_p(F.col("z_stat")).alias("p_value_two_sided"),
        )
    )
