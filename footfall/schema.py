"""Logical tables of the engine and the fixed values of its metric definitions."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: metric definitions -----------------------------------------
EVENT_TYPES = ("view", "cart", "purchase", "wishlist")
FUNNEL_STEPS = ("view", "cart", "purchase")
RETENTION_START_DAYS = 7
RETENTION_END_DAYS = 14
ATTRIBUTION_DAYS = 7
ACTIVATION_HOURS = 24
EXPERIMENT_NAME = "checkout_optimization"
CONTROL = "A_control"
TREATMENT = "B_treatment"

# --- input tables ---------------------------------------------------------------
# Declared, never inferred: inference costs one more pass over the log and its
# types change with the data. Timestamps carry no zone, so day arithmetic does
# not depend on the session's zone or on daylight saving.
EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
])
USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("gender", T.StringType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
])

# --- fixed values: output tables ----------------------------------------------------------------
FUNNEL_STAGES = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("users", T.LongType()),
])
FUNNEL_RATES = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("rate", T.DoubleType()),
    T.StructField("rate_pct", T.DoubleType()),
])
FUNNEL = T.StructType(FUNNEL_STAGES.fields + FUNNEL_RATES.fields)
COHORT_RETENTION = T.StructType([
    T.StructField("cohort_month", T.StringType()),
    T.StructField("cohort_users", T.LongType()),
    T.StructField("week1_users", T.LongType()),
    T.StructField("week1_retention", T.DoubleType()),
    T.StructField("week1_retention_pct", T.DoubleType()),
])
SEGMENT_CONVERSION = T.StructType([
    T.StructField("segment_type", T.StringType()),
    T.StructField("segment_value", T.StringType()),
    T.StructField("cart_users", T.LongType()),
    T.StructField("purchased", T.LongType()),
    T.StructField("cart_to_purchase_conversion", T.DoubleType()),
    T.StructField("cart_to_purchase_conversion_pct", T.DoubleType()),
])
AB_RESULTS = T.StructType([
    T.StructField("experiment_name", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("total_users", T.LongType()),
    T.StructField("success_users", T.LongType()),
    T.StructField("conversion_rate", T.DoubleType()),
    T.StructField("conversion_rate_pct", T.DoubleType()),
    T.StructField("week1_retention_rate", T.DoubleType()),
    T.StructField("week1_retention_rate_pct", T.DoubleType()),
    T.StructField("median_time_to_activation_hours", T.DoubleType()),
    T.StructField("mean_time_to_activation_hours", T.DoubleType()),
])
AB_SUMMARY = T.StructType([
    T.StructField("experiment_name", T.StringType()),
    T.StructField("control_variant", T.StringType()),
    T.StructField("treatment_variant", T.StringType()),
    T.StructField("control_conversion_rate", T.DoubleType()),
    T.StructField("treatment_conversion_rate", T.DoubleType()),
    T.StructField("lift_abs", T.DoubleType()),
    T.StructField("lift_abs_pct_points", T.DoubleType()),
    T.StructField("lift_rel", T.DoubleType()),
    T.StructField("z_stat", T.DoubleType()),
    T.StructField("p_value_two_sided", T.DoubleType()),
])
ASSIGNMENTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("experiment_name", T.StringType()),
])

ARTIFACTS = {
    "funnel_stages": FUNNEL_STAGES,
    "funnel_rates": FUNNEL_RATES,
    "funnel": FUNNEL,
    "cohort_retention": COHORT_RETENTION,
    "segment_conversion": SEGMENT_CONVERSION,
    "ab_results_by_variant": AB_RESULTS,
    "ab_results_summary": AB_SUMMARY,
    "experiment_assignments": ASSIGNMENTS,
}
