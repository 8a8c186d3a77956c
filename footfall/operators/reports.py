"""Presentation views over the result tables: labels, formats, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from footfall.functions.rates import percent, ratio
from footfall.functions.text import count_text, labelled, pct_text, title
from footfall.operators import segments as seg
from footfall.schema import CONTROL, FUNNEL_STEPS, TREATMENT

# --- fixed values: display labels --------------------------------------------------
RATE_LABELS = {
    "view_to_cart": "View → Cart",
    "cart_to_purchase_strict": "Strict Cart → Purchase",
    "view_to_purchase_overall": "View → Purchase (Overall)",
}
SEGMENT_TYPE_LABELS = {
    "gender": "Gender",
    "primary_cart_category": "Primary Cart Category",
}
RETENTION_LABELS = {
    "cohort_month": "Cohort Month",
    "cohort_users": "Cohort Users",
    "week1_users": "Week-1 Active Users",
    "week1_retention_pct": "Week-1 Retention (%)",
}
SEGMENT_LABELS = {
    "segment_value": "Segment",
    "cart_users": "Cart Users",
    "purchased": "Purchased Users",
    "cart_to_purchase_conversion_pct": "Strict Cart → Purchase (%)",
}
AB_LABELS = {
    "variant": "Variant",
    "total_users": "Users",
    "success_users": "Converted Users",
    "conversion_rate_pct": "Conversion (%)",
    "week1_retention_rate_pct": "Week-1 Retention (%)",
    "median_time_to_activation_hours": "Median Time-to-Activation (hrs)",
}


AB_HEADLINE_LABELS = ("Control Conversion", "Treatment Conversion")
LIFT_TEXT = "Lift (absolute): %.2f percentage points"
P_VALUE_TEXT = "p-value (two-sided): %.3f"
USERS_LABEL, STEP_LABEL = "{} Users", "{} → {}"
RETENTION_LABEL, ASSIGNMENTS_LABEL = "Week-1 Retention (overall)", "Assignment rows"


def _relabelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.select(*labels).withColumnsRenamed(labels)


def report_rates(rates: DataFrame) -> DataFrame:
    """Funnel rates with labels; a metric without a label keeps its name."""
    return rates.select(
        labelled(F.col("metric"), RATE_LABELS).alias("Metric"),
        pct_text(F.col("rate_pct")).alias("Rate"),
    )


def report_key_metrics(rates: DataFrame) -> DataFrame:
    """One line of text per funnel rate."""
    line = F.concat(title(F.col("metric")), F.lit(": "), pct_text(F.col("rate_pct")))
    return rates.select(line.alias("key_metric"))


def report_stages(stages: DataFrame) -> DataFrame:
    """Funnel stages with capitalised names and grouped digits."""
    return stages.select(
        title(F.col("stage")).alias("stage"), "users", count_text(F.col("users")).alias("label")
    )


def report_retention(cohorts: DataFrame) -> DataFrame:
    return _relabelled(cohorts.orderBy("cohort_month"), RETENTION_LABELS)


def report_segment_types(segments: DataFrame) -> DataFrame:
    """Choices for ``report_segments`` with their labels, sorted."""
    types = seg.segment_types(segments)
    return types.withColumn("label", labelled(F.col("segment_type"), SEGMENT_TYPE_LABELS))


def report_segments(segments: DataFrame, segment_type: str) -> DataFrame:
    """One segment type, worst converting segment first."""
    chosen = segments.where(F.col("segment_type") == segment_type).orderBy(
        F.asc("cart_to_purchase_conversion_pct"), F.asc("segment_value")
    )
    return _relabelled(chosen, SEGMENT_LABELS)


def report_top_segments(
    segments: DataFrame, k: int = 10, segment_type: str = "primary_cart_category"
) -> DataFrame:
    """The best converting segments as display text."""
    return seg.top_segments(segments, k, segment_type).select(
        F.col("segment_value").alias("Category"),
        count_text(F.col("cart_users")).alias("Cart Users"),
        pct_text(F.col("cart_to_purchase_conversion_pct")).alias("Conversion %"),
    )


def report_ab(results: DataFrame) -> DataFrame:
    return _relabelled(results, AB_LABELS)


def report_ab_headline(
    results: DataFrame, control: str = CONTROL, treatment: str = TREATMENT
) -> DataFrame:
    """Conversion of both variants side by side, as display text."""

    def conversion(variant: str):
        return F.max(F.when(F.col("variant") == variant, F.col("conversion_rate_pct")))

    return results.agg(
        pct_text(conversion(control)).alias(AB_HEADLINE_LABELS[0]),
        pct_text(conversion(treatment)).alias(AB_HEADLINE_LABELS[1]),
    )


def report_lift(summary: DataFrame) -> DataFrame:
    """Lift and p-value as display text."""
    return summary.select(
        F.format_string(LIFT_TEXT, "lift_abs_pct_points").alias("lift"),
        F.format_string(P_VALUE_TEXT, "p_value_two_sided").alias("p_value"),
    )


def kpis(facts: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """One row of headline figures, from a single aggregate over ``user_facts``."""
    first, middle, last = (F.col(f"has_{step}") for step in steps)
    a, b, c = steps
    strict = ratio(F.count_if(middle & last), F.count_if(middle), 0.0)
    in_cohort = F.col("first_event_ts").isNotNull()
    retention = ratio(F.count_if("week1_active"), F.count_if(in_cohort), 0.0)
    return facts.agg(
        F.count_if(first).alias(f"{a}_users"),
        F.count_if(middle).alias(f"{b}_users"),
        F.count_if(last).alias(f"{c}_users"),
        percent(strict).alias(f"{b}_to_{c}_strict_pct"),
        (retention * 100.0).alias("week1_retention_overall_pct"),
        F.count_if(middle).alias("assignment_rows"),
    )


def report_kpis(kpi_row: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """``kpis`` as display text."""
    _, b, c = steps
    return kpi_row.select(
        *(
            count_text(F.col(f"{step}_users")).alias(USERS_LABEL.format(step.title()))
            for step in steps
        ),
        pct_text(F.col(f"{b}_to_{c}_strict_pct")).alias(STEP_LABEL.format(b.title(), c.title())),
        pct_text(F.col("week1_retention_overall_pct")).alias(RETENTION_LABEL),
        count_text(F.col("assignment_rows")).alias(ASSIGNMENTS_LABEL),
    )
