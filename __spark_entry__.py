"""

Queries run on two bindings of the given tables, both whole:

* order history: customers as users, order lines as events, parts as products;
* clickstream (``clicks_*``, ``sanity_*``): the event stream, one visitor per account
  and device.

Timestamps are returned as text and long decimals rounded to 9 digits, so that two
engines' results compare by value.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from footfall.operators import (  # noqa: E402
    experiment,
    funnel,
    quality,
    reports,
    retention,
    segments,
    sketches,
)
from footfall.operators.users import (  # noqa: E402
    advanced,
    facts_of_periods,
    funnel_users,
    ordered_times,
    period_length,
    user_facts,
    user_flags,
    user_periods,
)
from footfall.plans import analyses, bindings, query_library  # noqa: E402
from footfall.sources import prepare_events, register_views  # noqa: E402

try:  # the training-data operators and their pipeline are a part that may be left out
    import corpus_pipeline
    from footfall.llm import queries as llm
except ImportError as error:
    missing = error.name or ""
    if missing not in ("corpus_pipeline", "footfall.llm") and not missing.startswith("footfall.llm."):
        raise  # it is there, but something that it needs isn't
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

ATTRIBUTE = "mktsegment"


def entry(spark: SparkSession) -> DataFrame:
    return queries()["funnel_strict_wide"](spark, "/root/testdata/sf0.001")


# --- queries ------------------------------------------------------------------------


def _text_ts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.order_history(spark, sf_dir).events


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.clickstream(spark, sf_dir)


def _on(source: Callable[[SparkSession, str], DataFrame], step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(source(spark, sf_dir))


def _on_tables(step: Callable[[bindings.Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(bindings.order_history(spark, sf_dir))


def _facts_out(events: DataFrame) -> DataFrame:
    facts = _text_ts(user_facts(events), "first_event_ts", "first_cart_ts")
    return _rounded(facts, "time_to_activation_hours")


def _attribution(events: DataFrame) -> DataFrame:
    facts = experiment.population(user_facts(events))
    return _text_ts(
        facts.select("user_id", "first_cart_ts", "purchase_within_7d"), "first_cart_ts"
    )


def _activation(events: DataFrame) -> DataFrame:
    facts = user_facts(events).select("user_id", "activated", "time_to_activation_hours")
    return _rounded(facts, "time_to_activation_hours")


def _ab(events: DataFrame) -> DataFrame:
    return experiment.ab_results(user_facts(events))


def _ab_approx_out(events: DataFrame) -> DataFrame:
    return _rounded(
        experiment.ab_results(user_facts(events), approx=True),
        "median_time_to_activation_hours",
        "mean_time_to_activation_hours",
    )


def _ab_out(events: DataFrame) -> DataFrame:
    return _rounded(
        _ab(events), "median_time_to_activation_hours", "mean_time_to_activation_hours"
    )


def _summary_out(events: DataFrame) -> DataFrame:
    summary = experiment.ab_summary(experiment.ab_totals(user_facts(events)))
    return _rounded(
        summary, "lift_abs", "lift_abs_pct_points", "lift_rel", "z_stat", "p_value_two_sided"
    )


def _library_ab(events: DataFrame) -> DataFrame:
    library = query_library.ab_test_primary_and_guardrails(user_facts(events))
    return _rounded(library, "median_time_to_activation_hours")


def _segment_table(t: bindings.Tables) -> DataFrame:
    return analyses.build_segment_conversion(t.events, t.users, t.products, ATTRIBUTE)


def _category_segments(t: bindings.Tables) -> DataFrame:
    return segments.segment_by_primary_category(
        funnel_users(t.events), segments.primary_category(t.events, t.products)
    )


def queries() -> dict[str, Query]:
    more = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    return {**library_queries(), **more}


def oracle_sql() -> dict[str, str]:
    return {**library_oracle_sql(), **(llm.oracle_sql() if llm else {})}


def _parsed_facts(text_events: DataFrame) -> DataFrame:
    return _facts_out(prepare_events(text_events))


def _window_facts(events: DataFrame) -> DataFrame:
    facts = _text_ts(user_facts(events, strategy="window"), "first_event_ts", "first_cart_ts")
    return _rounded(facts, "time_to_activation_hours")


def _sketched_users(events: DataFrame) -> DataFrame:
    """Estimates of whole weeks, and whether they are as near to the exact count as stated."""
    daily = sketches.daily_sketches(events)
    week = F.date_trunc("week", F.col("event_timestamp")).cast("date")
    exact = (
        events.where(F.col("user_id").isNotNull())
        .groupBy(week.alias("week"), "event_type")
        .agg(F.count_distinct("user_id").alias("exact_users"), F.count("*").alias("events"))
    )
    rolled = sketches.rolling_users(daily, 7).select(
        F.date_sub("event_date", 6).alias("week"), "event_type", "users"
    )
    off = F.abs(F.col("users") - F.col("exact_users"))
    bound = F.greatest(F.lit(1.0), F.col("exact_users") * sketches.relative_error(sigmas=4))
    return exact.join(rolled, ["week", "event_type"]).select(
        F.col("week").cast("string").alias("week"),
        "event_type",
        "events",
        "exact_users",
        (off <= bound).alias("within_error"),
    )


#: Bits of theta sketches that are exact for the tables here.
EXACT = 18


def _sketched_funnel(first: date | None, last: date | None) -> Callable[[DataFrame], DataFrame]:
    return lambda events: sketches.funnel_in_range(
        sketches.daily_sketches(events, "theta", EXACT), first, last, lg_k=EXACT
    )


def _sketched_by_parts(events: DataFrame) -> DataFrame:
    """Daily users by type, from two parts of the log that share all days."""
    half = F.pmod(F.xxhash64("user_id", "event_timestamp"), F.lit(2)) == 0
    parts = [sketches.daily_sketches(e, "theta", EXACT) for e in (events.where(half), events.where(~half))]
    merged = sketches.merge_days(*parts, "theta", EXACT)
    return merged.select(
        F.col("event_date").cast("string").alias("event_date"),
        "event_type",
        "events",
        F.theta_sketch_estimate("users").alias("users"),
    )


def _quarantined_out(events: DataFrame) -> DataFrame:
    bad = quality.quarantined(quality.judged(events))
    return bad.withColumn("reasons", F.array_join("reasons", ","))


def _kept_facts(events: DataFrame) -> DataFrame:
    """Facts of a log that came in two parts: by the week, and each part has late events."""
    ts = F.col("event_timestamp")
    late = F.pmod(F.weekofyear(ts), F.lit(3)) == 1
    first, second = events.where(~late), events.where(late | ts.isNull())
    periods = user_periods(first, period_length())
    _, facts = advanced(periods, facts_of_periods(periods), second)
    return _rounded(
        _text_ts(facts, "first_event_ts", "first_cart_ts"), "time_to_activation_hours"
    )


def _ordered_times_out(events: DataFrame) -> DataFrame:
    return _text_ts(ordered_times(events), "view_ts", "cart_ts", "purchase_ts")


def _gapped(step: Callable[[bindings.Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(bindings.gapped_order_history(spark, sf_dir))


def _gapped_segments(keep_null: bool) -> Query:
    return _gapped(
        lambda t: segments.segment_by_attribute(
            funnel_users(t.events), t.users, ATTRIBUTE, keep_null
        )
    )


def _sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bindings.order_history(spark, sf_dir)
    register_views(t.events, t.users, t.products)
    return spark.sql(
        """SELECT mktsegment, category, count(*) AS carts, count_if(activated) AS by_activated
           FROM events JOIN user_facts USING (user_id) JOIN users USING (user_id)
                JOIN products USING (product_id)
           WHERE event_type = 'cart' GROUP BY mktsegment, category"""
    )


def library_queries() -> dict[str, Query]:
    return {
        # data quality
        "sanity_missing_keys": _on(bindings.raw_clickstream, quality.missing_keys),
        "sanity_unexpected_types": _on(bindings.raw_clickstream, quality.unexpected_event_types),
        "sanity_bad_timestamps": _on(bindings.raw_clickstream, quality.bad_timestamps),
        "timestamp_forms": _on(bindings.raw_clickstream, quality.timestamp_forms),
        "patterned_bad_timestamps": _on(
            bindings.patterned_clickstream,
            lambda e: quality.bad_timestamps(e, bindings.CLOCK_PATTERN, bindings.CLOCK_ZONE),
        ),
        "patterned_timestamp_forms": _on(
            bindings.patterned_clickstream,
            lambda e: quality.timestamp_forms(e, bindings.CLOCK_PATTERN),
        ),
        "quarantine_counts": _on(
            bindings.raw_clickstream, lambda e: quality.quarantine_counts(quality.judged(e))
        ),
        "quarantined_events": _on(bindings.raw_clickstream, _quarantined_out),
        "good_user_facts": _on(
            bindings.raw_clickstream, lambda e: _facts_out(quality.good_events(quality.judged(e)))
        ),
        # per-user tables
        "user_flags": _on(_events, user_flags),
        "user_facts": _on(_events, _facts_out),
        "clicks_user_facts": _on(_clicks, _facts_out),
        "parsed_clicks_user_facts": _on(bindings.text_clickstream, _parsed_facts),
        "user_facts_window": _on(_events, _window_facts),
        "kept_user_facts": _on(_events, _kept_facts),
        "clicks_kept_user_facts": _on(_clicks, _kept_facts),
        "sql_views": _sql_views,
        # funnel
        "funnel_strict_wide": _on(_events, lambda e: funnel.funnel_wide(funnel_users(e))),
        "funnel_stages": _on(_events, lambda e: funnel.funnel_stages(funnel_users(e))),
        "funnel_rates_loose": _on(_events, lambda e: funnel.funnel_rates(funnel_users(e))),
        "funnel_rates_strict": _on(
            _events, lambda e: funnel.funnel_rates(funnel_users(e), "strict")
        ),
        "funnel_long": _on(_events, lambda e: funnel.funnel_long(funnel_users(e))),
        "funnel_leaks": _on(_events, lambda e: funnel.funnel_leaks(funnel_users(e))),
        "clicks_funnel_rates": _on(_clicks, lambda e: funnel.funnel_rates(funnel_users(e))),
        "ordered_times": _on(_events, _ordered_times_out),
        "clicks_ordered_times": _on(_clicks, _ordered_times_out),
        "accounts_ordered_times": _on(bindings.accounts, _ordered_times_out),
        "funnel_ordered_stages": _on(_clicks, lambda e: analyses.build_funnel(e, order="time").stages),
        "funnel_ordered_rates": _on(_clicks, lambda e: analyses.build_funnel(e, order="time").rates),
        "funnel_ordered_wide": _on(
            _clicks, lambda e: funnel.funnel_wide(funnel_users(e, order="time"))
        ),
        "gap_viewless_users": _on(
            _events, lambda e: funnel.users_without(user_flags(e), "view")
        ),
        "gap_purchase_without_cart": _on(
            _events, lambda e: funnel.users_without(user_flags(e), "cart", "purchase")
        ),
        "cart_and_purchase_users": _on(
            _events, lambda e: funnel.users_in_both(funnel_users(e), "cart", "purchase")
        ),
        "tracking_gaps": _on(_events, lambda e: funnel.tracking_gaps(user_flags(e))),
        "sketched_users": _on(_clicks, _sketched_users),
        "sketched_daily_users": _on(_clicks, _sketched_by_parts),
        "sketched_funnel": _on(_clicks, _sketched_funnel(None, None)),
        "sketched_funnel_range": _on(_clicks, _sketched_funnel(date(2024, 1, 5), date(2024, 1, 20))),
        # retention
        "cohort_month": _on(_events, analyses.build_cohort_retention_week1),
        "cohort_day": _on(_events, lambda e: analyses.build_cohort_retention_week1(e, "day")),
        "clicks_cohort_day": _on(
            _clicks, lambda e: analyses.build_cohort_retention_week1(e, "day")
        ),
        "overall_retention": _on(
            _events,
            lambda e: retention.overall_retention(retention.cohort_retention(user_facts(e))),
        ),
        "retention_by_activation": _on(
            _events, lambda e: retention.retention_by_activation(user_facts(e))
        ),
        "clicks_retention_by_activation": _on(
            _clicks, lambda e: retention.retention_by_activation(user_facts(e))
        ),
        # segments
        "segment_attribute": _on_tables(
            lambda t: segments.segment_by_attribute(funnel_users(t.events), t.users, ATTRIBUTE)
        ),
        "primary_category": _on_tables(
            lambda t: segments.primary_category(t.events, t.products)
        ),
        "primary_category_eager": _on_tables(
            lambda t: segments.primary_category(t.events, t.products, eager=True)
        ),
        "gapped_primary_category_eager": _gapped(
            lambda t: segments.primary_category(t.events, t.products, eager=True)
        ),
        "segment_category": _on_tables(_category_segments),
        "gapped_segment_attribute": _gapped_segments(keep_null=False),
        "gapped_segment_attribute_null": _gapped_segments(keep_null=True),
        "gapped_segment_category": _gapped(_category_segments),
        "segment_conversion": _on_tables(_segment_table),
        "segment_spread": _on_tables(lambda t: segments.segment_spread(_segment_table(t))),
        "segment_types": _on_tables(lambda t: segments.segment_types(_segment_table(t))),
        "top_segments": _on_tables(lambda t: segments.top_segments(_category_segments(t), 3)),
        # experiment
        "variant_assignment": _on(_events, lambda e: experiment.assignments(user_flags(e))),
        "attribution_7d": _on(_events, _attribution),
        "clicks_attribution_7d": _on(_clicks, _attribution),
        "time_to_activation": _on(_events, _activation),
        "clicks_time_to_activation": _on(_clicks, _activation),
        "ab_results": _on(_events, _ab_out),
        "clicks_ab_results": _on(_clicks, _ab_out),
        "accounts_ab_results": _on(bindings.accounts, _ab_out),
        "accounts_ab_results_approx": _on(bindings.accounts, _ab_approx_out),
        "ab_summary": _on(_events, _summary_out),
        "clicks_ab_summary": _on(_clicks, _summary_out),
        # presentation
        "report_rates": _on(
            _events, lambda e: reports.report_rates(funnel.funnel_rates(funnel_users(e)))
        ),
        "report_key_metrics": _on(
            _events, lambda e: reports.report_key_metrics(funnel.funnel_rates(funnel_users(e)))
        ),
        "report_stages": _on(
            _events, lambda e: reports.report_stages(funnel.funnel_stages(funnel_users(e)))
        ),
        "report_retention": _on(
            _events, lambda e: reports.report_retention(analyses.build_cohort_retention_week1(e))
        ),
        "report_segment_types": _on_tables(
            lambda t: reports.report_segment_types(_segment_table(t))
        ),
        "report_segments": _on_tables(
            lambda t: reports.report_segments(_segment_table(t), "primary_cart_category")
        ),
        "report_top_segments": _on_tables(
            lambda t: reports.report_top_segments(_category_segments(t), 3)
        ),
        "report_ab": _on(
            _clicks,
            lambda e: _rounded(
                reports.report_ab(_ab(e)), "Median Time-to-Activation (hrs)"
            ),
        ),
        "report_ab_headline": _on(
            _clicks,
            lambda e: reports.report_ab_headline(_ab(e)),
        ),
        "report_lift": _on(
            _clicks,
            lambda e: reports.report_lift(
                experiment.ab_summary(experiment.ab_totals(user_facts(e)))
            ),
        ),
        "kpis": _on(_events, lambda e: reports.kpis(user_facts(e))),
        "report_kpis": _on(_events, lambda e: reports.report_kpis(reports.kpis(user_facts(e)))),
        # query library conventions
        "library_missing_values": _on(bindings.raw_clickstream, quality.missing_keys),
        "library_unexpected_event_types": _on(_clicks, quality.unexpected_event_types),
        "library_funnel_dropoff": _on(_clicks, lambda e: funnel.funnel_wide(funnel_users(e))),
        "library_cohort_retention_week1": _on(_clicks, query_library.cohort_retention_week1),
        "library_conversion_by_segment": _on_tables(
            lambda t: query_library.conversion_by_segment(
                t.events, t.users, t.products, ATTRIBUTE
            )
        ),
        "library_ab_test": _on(_clicks, _library_ab),
    }


# --- SQL counterparts -----------------------------------------------------------------

_ORDER_EVENTS = """ev AS (
  SELECT o_custkey AS user_id, l_partkey AS product_id, o_orderdate AS ts,
         CASE WHEN o_orderstatus = 'O' THEN 'view' WHEN o_orderstatus = 'F' THEN 'cart'
              WHEN o_orderstatus = 'P' THEN 'purchase' ELSE o_orderstatus END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_CLICK_EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || regexp_extract(props, '[0-9]+') AS user_id, ts,
         CASE WHEN event_type = 'click' THEN 'cart' WHEN event_type = 'signup' THEN 'wishlist'
              ELSE event_type END AS kind
  FROM events)"""

_ACCOUNT_EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts,
         CASE WHEN event_type = 'click' THEN 'cart' WHEN event_type = 'signup' THEN 'wishlist'
              ELSE event_type END AS kind
  FROM events)"""

_RAW_CLICK_EVENTS = """ev AS (
  SELECT CASE WHEN event_type = 'signup' THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN value >= 2 THEN
                CASE event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'wishlist'
                                ELSE event_type END
              WHEN value >= 1 THEN '' END AS kind,
         CASE WHEN value < 60 THEN
                CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END
         END AS ts
  FROM events)"""

_PATTERNED = """ev AS (
  SELECT CASE WHEN value < 60 THEN
           CASE WHEN event_type = 'error' THEN props
                ELSE strftime(ts + INTERVAL 330 MINUTE, '%d.%m.%Y, %H-%M-%S') END END AS ts
  FROM events)"""

_JUDGED = """judged AS (
  SELECT user_id, kind, ts, list_filter([
    CASE WHEN coalesce(trim(user_id), '') = '' THEN 'missing_user_id' END,
    CASE WHEN coalesce(trim(kind), '') = '' THEN 'missing_event_type'
         WHEN kind NOT IN ('view', 'cart', 'purchase', 'wishlist') THEN 'unexpected_event_type' END,
    CASE WHEN ts IS NULL THEN 'missing_event_timestamp'
         WHEN try_cast(ts AS TIMESTAMP) IS NULL THEN 'unparsable_timestamp' END],
    lambda x: x IS NOT NULL) AS reasons
  FROM ev)"""

_FLAGS = """flags AS (
  SELECT user_id, bool_or(kind = 'view') AS v, bool_or(kind = 'cart') AS c,
         bool_or(kind = 'purchase') AS p
  FROM ev GROUP BY user_id)"""

_TOTALS = """totals AS (
  SELECT count(*) FILTER (WHERE v) AS nv, count(*) FILTER (WHERE c) AS nc,
         count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE v AND c) AS nvc,
         count(*) FILTER (WHERE c AND p) AS ncp, count(*) FILTER (WHERE v AND p) AS nvp
  FROM flags)"""

_FACTS = _FLAGS + """,
anchors AS (
  SELECT user_id, min(ts) AS first_event, min(ts) FILTER (WHERE kind = 'cart') AS first_cart
  FROM ev GROUP BY user_id),
facts AS (
  SELECT user_id, any_value(v) AS v, any_value(c) AS c, any_value(p) AS p,
         any_value(first_event) AS first_event, any_value(first_cart) AS first_cart,
         bool_or(ts >= first_event + INTERVAL 7 DAY AND ts < first_event + INTERVAL 14 DAY)
           AS week1,
         coalesce(bool_or(kind = 'purchase' AND ts >= first_cart
                          AND ts < first_cart + INTERVAL 7 DAY), false) AS bought,
         min(CASE WHEN kind = 'purchase' AND ts >= first_event
                       AND ts < first_event + INTERVAL 24 HOUR
                  THEN epoch_us(ts) - epoch_us(first_event) END) / 3600000000.0 AS hours
  FROM ev JOIN anchors USING (user_id) JOIN flags USING (user_id) GROUP BY user_id)"""

_VARIANTS = """members AS (
  SELECT *, CASE WHEN ('0x' || right(md5(CAST(user_id AS VARCHAR)), 1))::INT % 2 = 0
                 THEN 'A_control' ELSE 'B_treatment' END AS variant
  FROM facts WHERE c)"""

_READOUT = _VARIANTS + """,
readout AS (
  SELECT variant, count(*) AS n, count(*) FILTER (WHERE bought) AS x,
         count(*) FILTER (WHERE week1) AS w,
         CAST(quantile_cont(hours, 0.5) AS DOUBLE) AS median_h,
         CAST(avg(CAST(hours AS DOUBLE)) AS DOUBLE) AS mean_h
  FROM members GROUP BY variant)"""

# The p-value integrates the normal density by Simpson's rule.
_SUMMARY = _READOUT + """,
pair AS (
  SELECT CAST(sum(n) FILTER (WHERE variant = 'A_control') AS DOUBLE) AS n1,
         CAST(sum(x) FILTER (WHERE variant = 'A_control') AS DOUBLE) AS x1,
         CAST(sum(n) FILTER (WHERE variant = 'B_treatment') AS DOUBLE) AS n2,
         CAST(sum(x) FILTER (WHERE variant = 'B_treatment') AS DOUBLE) AS x2
  FROM readout),
rates AS (
  SELECT *, x1 / n1 AS p1, x2 / n2 AS p2, (x1 + x2) / (n1 + n2) AS pool FROM pair),
tested AS (
  SELECT *, (p2 - p1) / nullif(sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)), 0) AS z FROM rates),
density AS (
  SELECT abs(z) / 2000 AS h,
         exp(-0.5 * (abs(z) * i / 2000) * (abs(z) * i / 2000)) / sqrt(2 * pi()) AS y,
         CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight
  FROM tested, range(0, 2001) AS r(i)),
summary AS (
  SELECT tested.*, 1 - 2 * (SELECT sum(weight * y) * max(h) / 3 FROM density) AS pv FROM tested)"""

_ORDERED = """viewed AS (SELECT user_id, min(ts) AS t1 FROM ev WHERE kind = 'view' GROUP BY user_id),
carted AS (
  SELECT user_id, any_value(t1) AS t1, min(ts) FILTER (WHERE kind = 'cart' AND ts >= t1) AS t2
  FROM viewed JOIN ev USING (user_id) GROUP BY user_id),
ordered AS (
  SELECT user_id, any_value(t1) AS t1, any_value(t2) AS t2,
         min(ts) FILTER (WHERE kind = 'purchase' AND ts >= t2) AS t3
  FROM carted JOIN ev USING (user_id) GROUP BY user_id),
flags AS (SELECT user_id, true AS v, t2 IS NOT NULL AS c, t3 IS NOT NULL AS p FROM ordered)"""

_PRIMARY = """per_category AS (
  SELECT user_id, p_type AS category, count(*) AS cnt, min(ts) AS seen
  FROM ev JOIN part ON product_id = p_partkey WHERE kind = 'cart' GROUP BY ALL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY cnt DESC, seen, category) AS r
  FROM per_category),
preferred AS (SELECT user_id, category FROM ranked WHERE r = 1)"""

_SEGMENTS = _FLAGS + ",\n" + _PRIMARY + """,
seg AS (
  SELECT 'mktsegment' AS segment_type, c_mktsegment AS segment_value,
         count(DISTINCT user_id) AS cart_users,
         count(DISTINCT user_id) FILTER (WHERE p) AS purchased
  FROM flags JOIN customer ON user_id = c_custkey WHERE c GROUP BY c_mktsegment
  UNION ALL
  SELECT 'primary_cart_category', category, count(DISTINCT user_id),
         count(DISTINCT user_id) FILTER (WHERE p)
  FROM flags JOIN preferred USING (user_id) WHERE c GROUP BY category),
segs AS (
  SELECT *, CAST(purchased AS DOUBLE) / cart_users AS cart_to_purchase_conversion,
         round_even(100.0::DOUBLE * (CAST(purchased AS DOUBLE) / cart_users), 2)
           AS cart_to_purchase_conversion_pct
  FROM seg)"""

_RETENTION_RATES = """
       CAST(count(*) FILTER (WHERE week1) AS DOUBLE) / count(*) AS week1_retention,
       round_even(100.0::DOUBLE * (CAST(count(*) FILTER (WHERE week1) AS DOUBLE) / count(*)), 2)
         AS week1_retention_pct"""

_TEXT_TS = "CAST({0} AS VARCHAR)"

_FACTS_OUT = f"""SELECT user_id, v AS has_view, c AS has_cart, p AS has_purchase,
       {_TEXT_TS.format('first_event')} AS first_event_ts,
       {_TEXT_TS.format('first_cart')} AS first_cart_ts,
       week1 AS week1_active, bought AS purchase_within_7d,
       round(CAST(hours AS DOUBLE), 9) AS time_to_activation_hours,
       hours IS NOT NULL AS activated
FROM facts"""

_LOOSE = """loose AS (
  SELECT 1 AS ord, 'view_to_cart' AS metric,
         coalesce(CAST(nc AS DOUBLE) / nullif(nv, 0), 0) AS rate FROM totals
  UNION ALL
  SELECT 2, 'cart_to_purchase_strict', coalesce(CAST(ncp AS DOUBLE) / nullif(nc, 0), 0)
  FROM totals
  UNION ALL
  SELECT 3, 'view_to_purchase_overall', coalesce(CAST(np AS DOUBLE) / nullif(nv, 0), 0)
  FROM totals)"""

_STAGES = """stages AS (
  SELECT 1 AS step_no, 'view' AS stage, nv AS users FROM totals UNION ALL
  SELECT 2, 'cart', nc FROM totals UNION ALL
  SELECT 3, 'purchase', np FROM totals)"""

_PCT = "round_even(100.0::DOUBLE * rate, 2)"

_ORDERED_OUT = f"""SELECT user_id, {_TEXT_TS.format('t1')} AS view_ts,
       {_TEXT_TS.format('t2')} AS cart_ts, {_TEXT_TS.format('t3')} AS purchase_ts
FROM ordered"""

_ATTRIBUTION_OUT = f"""SELECT user_id, {_TEXT_TS.format('first_cart')} AS first_cart_ts,
       bought AS purchase_within_7d
FROM facts WHERE c"""

_ACTIVATION_OUT = """SELECT user_id, hours IS NOT NULL AS activated,
       round(CAST(hours AS DOUBLE), 9) AS time_to_activation_hours
FROM facts"""

_BY_ACTIVATION_OUT = f"""SELECT hours IS NOT NULL AS activated, count(*) AS cohort_users,
       count(*) FILTER (WHERE week1) AS week1_users,{_RETENTION_RATES}
FROM facts GROUP BY ALL"""

_AB_OUT = """SELECT 'checkout_optimization' AS experiment_name, variant, n AS total_users,
       x AS success_users, CAST(x AS DOUBLE) / n AS conversion_rate,
       round_even(100.0::DOUBLE * (CAST(x AS DOUBLE) / n), 4) AS conversion_rate_pct,
       CAST(w AS DOUBLE) / n AS week1_retention_rate,
       round_even(100.0::DOUBLE * (CAST(w AS DOUBLE) / n), 4) AS week1_retention_rate_pct,
       round(median_h, 9) AS median_time_to_activation_hours,
       round(mean_h, 9) AS mean_time_to_activation_hours
FROM readout"""

_SUMMARY_OUT = """SELECT 'checkout_optimization' AS experiment_name,
       'A_control' AS control_variant, 'B_treatment' AS treatment_variant,
       p1 AS control_conversion_rate, p2 AS treatment_conversion_rate,
       round(p2 - p1, 9) AS lift_abs, round((p2 - p1) * 100, 9) AS lift_abs_pct_points,
       round((p2 - p1) / nullif(p1, 0), 9) AS lift_rel, round(z, 9) AS z_stat,
       round(pv, 9) AS p_value_two_sided
FROM summary"""


def _with(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _cohort_out(label: str, name: str, events: str) -> str:
    return _with(
        events,
        _FACTS,
        f"SELECT {label} AS {name}, count(*) AS cohort_users, "
        f"count(*) FILTER (WHERE week1) AS week1_users,{_RETENTION_RATES}\n"
        "FROM facts GROUP BY ALL",
    )


def library_oracle_sql() -> dict[str, str]:
    orders, clicks, raw = _ORDER_EVENTS, _CLICK_EVENTS, _RAW_CLICK_EVENTS
    month, day = "strftime(first_event, '%Y-%m')", "strftime(first_event, '%Y-%m-%d')"
    missing = """SELECT count(*) FILTER (WHERE coalesce(trim(user_id), '') = '') AS missing_user_id,
       count(*) FILTER (WHERE coalesce(trim(kind), '') = '') AS missing_event_type,
       count(*) FILTER (WHERE ts IS NULL) AS missing_event_timestamp FROM ev"""
    unexpected = """SELECT kind AS event_type, count(*) AS cnt FROM ev
WHERE kind <> 'view' AND kind <> 'cart' AND kind <> 'purchase' AND kind <> 'wishlist'
GROUP BY kind"""
    wide = """SELECT nv AS view_users, nc AS cart_users, np AS purchase_users,
       CAST(nvc AS DOUBLE) / nullif(nv, 0) AS view_to_cart_conversion,
       CAST(ncp AS DOUBLE) / nullif(nc, 0) AS cart_to_purchase_conversion_strict,
       CAST(nvp AS DOUBLE) / nullif(nv, 0) AS view_to_purchase_conversion_overall
FROM totals"""
    loose = f"SELECT metric, rate, {_PCT} AS rate_pct FROM loose"
    gapped = """listed AS (
  SELECT c_custkey AS user_id, nullif(c_mktsegment, 'MACHINERY') AS value FROM customer
  UNION ALL SELECT c_custkey, 'ANY' FROM customer),
gapped_parts AS (
  SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'SMALL'))"""
    by_value = """SELECT 'mktsegment' AS segment_type, value AS segment_value,
       count(DISTINCT user_id) AS cart_users, count(DISTINCT user_id) FILTER (WHERE p) AS purchased,
       CAST(count(DISTINCT user_id) FILTER (WHERE p) AS DOUBLE) / count(DISTINCT user_id)
         AS cart_to_purchase_conversion,
       round_even(100.0::DOUBLE * (CAST(count(DISTINCT user_id) FILTER (WHERE p) AS DOUBLE)
                                   / count(DISTINCT user_id)), 2)
         AS cart_to_purchase_conversion_pct
FROM flags JOIN listed USING (user_id) WHERE c {0} GROUP BY value"""
    segment_columns = """SELECT segment_type, segment_value, cart_users, purchased,
       cart_to_purchase_conversion, cart_to_purchase_conversion_pct FROM segs"""
    return {
        "sanity_missing_keys": _with(raw, missing),
        "sanity_unexpected_types": _with(raw, unexpected),
        "sanity_bad_timestamps": _with(raw, """SELECT count(*) AS events,
       count(*) FILTER (WHERE ts IS NULL) AS missing_timestamps,
       count(*) FILTER (WHERE ts IS NOT NULL AND try_cast(ts AS TIMESTAMP) IS NULL)
         AS unparsable_timestamps FROM ev"""),
        "patterned_bad_timestamps": _with(_PATTERNED, """SELECT count(*) AS events,
       count(*) FILTER (WHERE ts IS NULL) AS missing_timestamps,
       count(*) FILTER (WHERE ts IS NOT NULL AND
         try_strptime(ts, '%d.%m.%Y, %H-%M-%S') IS NULL) AS unparsable_timestamps FROM ev"""),
        "patterned_timestamp_forms": _with(_PATTERNED, """SELECT 0::BIGINT AS with_zone,
       count(*) FILTER (WHERE try_strptime(ts, '%d.%m.%Y, %H-%M-%S') IS NOT NULL)
         AS without_zone FROM ev"""),
        "quarantine_counts": _with(raw, _JUDGED, """each AS (
  SELECT unnest(reasons) AS reason FROM judged
  UNION ALL SELECT CASE WHEN len(reasons) = 0 THEN '(good)' ELSE '(quarantined)' END FROM judged)""",
            "SELECT reason, count(*) AS cnt FROM each GROUP BY reason"),
        "quarantined_events": _with(raw, _JUDGED, """SELECT user_id, kind AS event_type,
       ts AS event_timestamp, array_to_string(reasons, ',') AS reasons
FROM judged WHERE len(reasons) > 0"""),
        "good_user_facts": _with(raw.replace("ev AS", "raw AS"), _JUDGED.replace("FROM ev", "FROM raw"),
            """ev AS (SELECT user_id, kind, CAST(ts AS TIMESTAMP) AS ts
  FROM judged WHERE len(reasons) = 0)""", _FACTS, _FACTS_OUT),
        "user_flags": _with(orders, _FLAGS, """SELECT user_id, v AS has_view, c AS has_cart,
       p AS has_purchase FROM flags"""),
        "user_facts": _with(orders, _FACTS, _FACTS_OUT),
        "clicks_user_facts": _with(clicks, _FACTS, _FACTS_OUT),
        "parsed_clicks_user_facts": _with(clicks, _FACTS, _FACTS_OUT),
        "user_facts_window": _with(orders, _FACTS, _FACTS_OUT),
        "kept_user_facts": _with(orders, _FACTS, _FACTS_OUT),
        "clicks_kept_user_facts": _with(clicks, _FACTS, _FACTS_OUT),
        "sql_views": _with(orders, _FACTS, """SELECT c_mktsegment AS mktsegment,
       p_type AS category, count(*) AS carts, count(*) FILTER (WHERE hours IS NOT NULL) AS by_activated
FROM ev JOIN facts USING (user_id) JOIN customer ON user_id = c_custkey
     JOIN part ON product_id = p_partkey
WHERE kind = 'cart' GROUP BY c_mktsegment, p_type"""),
        "timestamp_forms": _with(raw, """SELECT 0::BIGINT AS with_zone,
       count(*) FILTER (WHERE try_cast(ts AS TIMESTAMP) IS NOT NULL) AS without_zone FROM ev"""),
        "gapped_segment_attribute": _with(
            orders, _FLAGS, gapped, by_value.format("AND value IS NOT NULL")),
        "gapped_segment_attribute_null": _with(orders, _FLAGS, gapped, by_value.format("")),
        "gapped_segment_category": _with(
            orders, _FLAGS, gapped, _PRIMARY.replace("JOIN part ", "JOIN gapped_parts "),
            """SELECT 'primary_cart_category' AS segment_type, category AS segment_value,
       count(*) AS cart_users, count(*) FILTER (WHERE p) AS purchased,
       CAST(count(*) FILTER (WHERE p) AS DOUBLE) / count(*) AS cart_to_purchase_conversion,
       round_even(100.0::DOUBLE * (CAST(count(*) FILTER (WHERE p) AS DOUBLE) / count(*)), 2)
         AS cart_to_purchase_conversion_pct
FROM flags JOIN preferred USING (user_id) GROUP BY category"""),
        "accounts_ab_results": _with(_ACCOUNT_EVENTS, _FACTS, _READOUT, _AB_OUT),
        # the lower of two middle values
        "accounts_ab_results_approx": _with(_ACCOUNT_EVENTS, _FACTS, _READOUT.replace(
            "CAST(quantile_cont(hours, 0.5) AS DOUBLE)",
            "CAST(list_sort(list(hours) FILTER (WHERE hours IS NOT NULL))"
            "[CAST(ceil(count(hours) / 2) AS INT)] AS DOUBLE)"), _AB_OUT),
        "funnel_strict_wide": _with(orders, _FLAGS, _TOTALS, wide),
        "funnel_stages": _with(orders, _FLAGS, _TOTALS, _STAGES, "SELECT stage, users FROM stages"),
        "funnel_rates_loose": _with(orders, _FLAGS, _TOTALS, _LOOSE, loose),
        "funnel_rates_strict": _with(orders, _FLAGS, _TOTALS, f"""strict AS (
  SELECT 'view_to_cart' AS metric, CAST(nvc AS DOUBLE) / nullif(nv, 0) AS rate FROM totals
  UNION ALL
  SELECT 'cart_to_purchase_strict', CAST(ncp AS DOUBLE) / nullif(nc, 0) FROM totals
  UNION ALL
  SELECT 'view_to_purchase_overall', CAST(nvp AS DOUBLE) / nullif(nv, 0) FROM totals)""",
            f"SELECT metric, rate, {_PCT} AS rate_pct FROM strict"),
        "funnel_long": _with(orders, _FLAGS, _TOTALS, _STAGES, _LOOSE,
            f"SELECT stage, users, metric, rate, {_PCT} AS rate_pct FROM stages, loose"),
        "funnel_leaks": _with(orders, _FLAGS, _TOTALS, _STAGES, """steps AS (
  SELECT *, lag(users) OVER (ORDER BY step_no) AS prev FROM stages),
lost AS (
  SELECT step_no, stage, users, prev - users AS lost_users,
         CAST(prev - users AS DOUBLE) / prev AS lost_rate FROM steps)""",
            """SELECT *, coalesce(lost_rate = (SELECT max(lost_rate) FROM lost), false)
         AS largest_leak FROM lost"""),
        "clicks_funnel_rates": _with(clicks, _FLAGS, _TOTALS, _LOOSE, loose),
        "sketched_users": _with(clicks, """ends AS (SELECT max(CAST(ts AS DATE)) AS last FROM ev)""",
            """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, kind AS event_type,
       count(*) AS events, count(DISTINCT user_id) AS exact_users, true AS within_error
FROM ev, ends GROUP BY date_trunc('week', ts), kind, last
HAVING CAST(date_trunc('week', ts) AS DATE) + 6 <= last"""),
        "sketched_daily_users": _with(clicks, """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date,
       kind AS event_type, count(*) AS events, count(DISTINCT user_id) AS users
FROM ev GROUP BY CAST(ts AS DATE), kind"""),
        "sketched_funnel": _with(clicks, _FLAGS, _TOTALS, wide),
        "sketched_funnel_range": _with(clicks.replace("ev AS", "whole AS"), """ev AS (
  SELECT * FROM whole WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21')""",
            _FLAGS, _TOTALS, wide),
        "ordered_times": _with(orders, _ORDERED, _ORDERED_OUT),
        "clicks_ordered_times": _with(clicks, _ORDERED, _ORDERED_OUT),
        "accounts_ordered_times": _with(_ACCOUNT_EVENTS, _ORDERED, _ORDERED_OUT),
        "funnel_ordered_stages": _with(
            clicks, _ORDERED, _TOTALS, _STAGES, "SELECT stage, users FROM stages"),
        "funnel_ordered_rates": _with(clicks, _ORDERED, _TOTALS, _LOOSE, loose),
        "funnel_ordered_wide": _with(clicks, _ORDERED, _TOTALS, wide),
        "gap_viewless_users": _with(orders, """viewers AS (
  SELECT DISTINCT user_id FROM ev WHERE kind = 'view')""",
            "SELECT DISTINCT user_id FROM ev ANTI JOIN viewers USING (user_id)"),
        "gap_purchase_without_cart": _with(orders, """SELECT user_id FROM ev WHERE kind = 'purchase'
EXCEPT SELECT user_id FROM ev WHERE kind = 'cart'"""),
        "cart_and_purchase_users": _with(orders, """SELECT user_id FROM ev WHERE kind = 'purchase'
INTERSECT SELECT user_id FROM ev WHERE kind = 'cart'"""),
        "tracking_gaps": _with(orders, _FLAGS, """SELECT
       count(*) FILTER (WHERE NOT v) AS users_without_view,
       count(*) FILTER (WHERE p AND NOT c) AS purchase_users_without_cart,
       count(*) FILTER (WHERE c AND p) AS cart_and_purchase_users,
       CAST(count(*) FILTER (WHERE c AND p) AS DOUBLE) / count(*) FILTER (WHERE c) AS strict_rate,
       CAST(count(*) FILTER (WHERE p) AS DOUBLE) / count(*) FILTER (WHERE c) AS looser_rate,
       round_even(100.0::DOUBLE * (CAST(count(*) FILTER (WHERE p) AS DOUBLE)
                  / count(*) FILTER (WHERE c)), 1) AS looser_rate_pct
FROM flags"""),
        "cohort_month": _cohort_out(month, "cohort_month", orders),
        "cohort_day": _cohort_out(day, "cohort_date", orders),
        "clicks_cohort_day": _cohort_out(day, "cohort_date", clicks),
        "overall_retention": _with(orders, _FACTS, f"""SELECT count(*) AS cohort_users,
       count(*) FILTER (WHERE week1) AS week1_users,{_RETENTION_RATES}
FROM facts"""),
        "retention_by_activation": _with(orders, _FACTS, _BY_ACTIVATION_OUT),
        "clicks_retention_by_activation": _with(clicks, _FACTS, _BY_ACTIVATION_OUT),
        "segment_attribute": _with(
            orders, _SEGMENTS, segment_columns + " WHERE segment_type = 'mktsegment'"),
        "primary_category": _with(
            orders, _PRIMARY, "SELECT user_id, category AS primary_cart_category FROM preferred"),
        "primary_category_eager": _with(
            orders, _PRIMARY, "SELECT user_id, category AS primary_cart_category FROM preferred"),
        "gapped_primary_category_eager": _with(
            orders, gapped, _PRIMARY.replace("JOIN part ", "JOIN gapped_parts "),
            "SELECT user_id, category AS primary_cart_category FROM preferred"),
        "segment_category": _with(
            orders, _SEGMENTS, segment_columns + " WHERE segment_type = 'primary_cart_category'"),
        "segment_conversion": _with(orders, _SEGMENTS, segment_columns),
        "segment_spread": _with(orders, _SEGMENTS, """SELECT segment_type,
       min(cart_to_purchase_conversion_pct) AS min_pct,
       max(cart_to_purchase_conversion_pct) AS max_pct,
       round_even(max(cart_to_purchase_conversion_pct)
                  - min(cart_to_purchase_conversion_pct), 2) AS spread_pp
FROM segs GROUP BY segment_type"""),
        "segment_types": _with(orders, _SEGMENTS, "SELECT DISTINCT segment_type FROM segs"),
        "top_segments": _with(orders, _SEGMENTS, """SELECT segment_value, cart_users,
       cart_to_purchase_conversion_pct FROM segs WHERE segment_type = 'primary_cart_category'
ORDER BY cart_to_purchase_conversion_pct DESC, segment_value LIMIT 3"""),
        "variant_assignment": _with(orders, _FACTS, _VARIANTS, """SELECT user_id, variant,
       'checkout_optimization' AS experiment_name FROM members"""),
        "attribution_7d": _with(orders, _FACTS, _ATTRIBUTION_OUT),
        "clicks_attribution_7d": _with(clicks, _FACTS, _ATTRIBUTION_OUT),
        "time_to_activation": _with(orders, _FACTS, _ACTIVATION_OUT),
        "clicks_time_to_activation": _with(clicks, _FACTS, _ACTIVATION_OUT),
        "ab_results": _with(orders, _FACTS, _READOUT, _AB_OUT),
        "clicks_ab_results": _with(clicks, _FACTS, _READOUT, _AB_OUT),
        "ab_summary": _with(orders, _FACTS, _SUMMARY, _SUMMARY_OUT),
        "clicks_ab_summary": _with(clicks, _FACTS, _SUMMARY, _SUMMARY_OUT),
        "report_rates": _with(orders, _FLAGS, _TOTALS, _LOOSE, f"""SELECT
       CASE ord WHEN 1 THEN 'View → Cart' WHEN 2 THEN 'Strict Cart → Purchase'
                ELSE 'View → Purchase (Overall)' END AS "Metric",
       printf('%.2f%%', {_PCT}) AS "Rate" FROM loose"""),
        "report_key_metrics": _with(orders, _FLAGS, _TOTALS, _LOOSE, f"""SELECT
       CASE ord WHEN 1 THEN 'View To Cart' WHEN 2 THEN 'Cart To Purchase Strict'
                ELSE 'View To Purchase Overall' END || printf(': %.2f%%', {_PCT}) AS key_metric
FROM loose"""),
        "report_stages": _with(orders, _FLAGS, _TOTALS, _STAGES, """SELECT
       upper(left(stage, 1)) || substr(stage, 2) AS stage, users,
       format('{:,}', users) AS label FROM stages"""),
        "report_retention": _with(orders, _FACTS, f"""SELECT {month} AS "Cohort Month",
       count(*) AS "Cohort Users", count(*) FILTER (WHERE week1) AS "Week-1 Active Users",
       round_even(100.0::DOUBLE * (CAST(count(*) FILTER (WHERE week1) AS DOUBLE) / count(*)), 2)
         AS "Week-1 Retention (%)"
FROM facts GROUP BY 1"""),
        "report_segment_types": _with(orders, _SEGMENTS, """SELECT DISTINCT segment_type,
       CASE segment_type WHEN 'primary_cart_category' THEN 'Primary Cart Category'
                         ELSE segment_type END AS label FROM segs"""),
        "report_segments": _with(orders, _SEGMENTS, """SELECT segment_value AS "Segment",
       cart_users AS "Cart Users", purchased AS "Purchased Users",
       cart_to_purchase_conversion_pct AS "Strict Cart → Purchase (%)"
FROM segs WHERE segment_type = 'primary_cart_category'"""),
        "report_top_segments": _with(orders, _SEGMENTS, """SELECT segment_value AS "Category",
       format('{:,}', cart_users) AS "Cart Users",
       printf('%.2f%%', cart_to_purchase_conversion_pct) AS "Conversion %"
FROM segs WHERE segment_type = 'primary_cart_category'
ORDER BY cart_to_purchase_conversion_pct DESC, segment_value LIMIT 3"""),
        "report_ab": _with(clicks, _FACTS, _READOUT, """SELECT variant AS "Variant", n AS "Users",
       x AS "Converted Users",
       round_even(100.0::DOUBLE * (CAST(x AS DOUBLE) / n), 4) AS "Conversion (%)",
       round_even(100.0::DOUBLE * (CAST(w AS DOUBLE) / n), 4) AS "Week-1 Retention (%)",
       round(median_h, 9) AS "Median Time-to-Activation (hrs)"
FROM readout"""),
        "report_ab_headline": _with(clicks, _FACTS, _SUMMARY, """SELECT
       printf('%.2f%%', 100 * p1) AS "Control Conversion",
       printf('%.2f%%', 100 * p2) AS "Treatment Conversion" FROM summary"""),
        "report_lift": _with(clicks, _FACTS, _SUMMARY, """SELECT
       printf('Lift (absolute): %.2f percentage points', 100 * (p2 - p1)) AS lift,
       printf('p-value (two-sided): %.3f', pv) AS p_value FROM summary"""),
        "kpis": _with(orders, _FACTS, _TOTALS, """SELECT nv AS view_users, nc AS cart_users,
       np AS purchase_users,
       round_even(100.0::DOUBLE * (CAST(ncp AS DOUBLE) / nc), 2) AS cart_to_purchase_strict_pct,
       100.0::DOUBLE * ((SELECT CAST(count(*) FILTER (WHERE week1) AS DOUBLE) / count(*)
                         FROM facts)) AS week1_retention_overall_pct,
       nc AS assignment_rows FROM totals"""),
        "report_kpis": _with(orders, _FACTS, _TOTALS, """SELECT
       format('{:,}', nv) AS "View Users", format('{:,}', nc) AS "Cart Users",
       format('{:,}', np) AS "Purchase Users",
       printf('%.2f%%', round_even(100.0::DOUBLE * (CAST(ncp AS DOUBLE) / nc), 2))
         AS "Cart → Purchase",
       printf('%.2f%%', (SELECT 100.0 * count(*) FILTER (WHERE week1) / count(*) FROM facts))
         AS "Week-1 Retention (overall)",
       format('{:,}', nc) AS "Assignment rows" FROM totals"""),
        "library_missing_values": _with(raw, missing),
        "library_unexpected_event_types": _with(clicks, unexpected),
        "library_funnel_dropoff": _with(clicks, _FLAGS, _TOTALS, wide),
        "library_cohort_retention_week1": _with(clicks, _FACTS, f"""SELECT {day} AS cohort_month,
       count(*) AS cohort_users, count(*) FILTER (WHERE week1) AS week1_users,
       CAST(count(*) FILTER (WHERE week1) AS DOUBLE) / count(*) AS week1_retention_rate
FROM facts GROUP BY 1"""),
        "library_conversion_by_segment": _with(orders, _SEGMENTS, """SELECT segment_type,
       segment_value, cart_users, purchased AS purchased_users, cart_to_purchase_conversion
FROM segs"""),
        "library_ab_test": _with(clicks, _FACTS, _READOUT, """SELECT variant, n AS total_users,
       x AS success_users, CAST(x AS DOUBLE) / n AS conversion_rate,
       CAST(w AS DOUBLE) / n AS week1_retention_rate,
       round(median_h, 9) AS median_time_to_activation_hours FROM readout"""),
    }
