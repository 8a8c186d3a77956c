"""Shape of the physical plans: what is shuffled, pushed down and broadcast."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from conftest import table_dir
from footfall.operators import experiment, segments
from footfall.operators.users import funnel_users, user_facts, user_flags, user_periods
from footfall.sources import write_artifact

EVENTS = "user_id STRING, product_id STRING, event_type STRING, event_timestamp TIMESTAMP_NTZ"
T0 = datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", text)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A Parquet log in which one user and one product hold a third of the events."""
    path = str(tmp_path_factory.mktemp("log"))
    spark.range(60_000, numPartitions=6).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('u', id % 997)) AS user_id",
        "IF(id % 3 = 1, 'p0', concat('p', id % 101)) AS product_id",
        "element_at(array('view', 'cart', 'purchase', 'wishlist'), 1 + CAST(id % 4 AS INT))"
        " AS event_type",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 50000 AS INT))"
        " AS event_timestamp",
        "repeat('x', 20) AS payload",
    ).write.parquet(f"{path}/events")
    return spark.read.parquet(f"{path}/events")


def test_facts_shuffle_aggregated_rows_only(events):
    text = plan(user_facts(events))
    first, second = exchanges(text)[::-1]
    assert "user_id" in first and "_groupingexpression" in first
    assert "user_id" in second and "_groupingexpression" not in second
    # Below the lower exchange: a partial aggregate straight over the scan.
    below = text[text.rindex("Exchange"):]
    assert below.count("HashAggregate") == 1 and "partial_min" in below
    assert "Join" not in text
    assert "payload" not in text


def test_a_user_has_a_bounded_number_of_periods(spark):
    rows = [("hot", None, "cart", T0 + timedelta(minutes=7 * i)) for i in range(20_000)]
    periods = user_periods(spark.createDataFrame(rows, EVENTS), 7)
    span_days = 20_000 * 7 / 1440
    assert periods.count() <= span_days / 7 + 2


def test_flags_are_one_shuffle_of_aggregated_rows(events):
    text = plan(user_flags(events))
    assert len(exchanges(text)) == 1
    assert "partial_bit_or" in text[text.rindex("Exchange"):]


def test_funnel_filter_and_columns_reach_the_scan(events):
    text = plan(funnel_users(events))
    assert "In(event_type, [cart,purchase,view])" in text
    assert re.search(r"ReadSchema: struct<user_id:string,event_type:string>", text)


def test_primary_category_prunes_before_the_user_shuffle(events, spark):
    products = spark.range(101).selectExpr("concat('p', id) AS product_id", "'A' AS category")
    text = plan(segments.primary_category(events, products))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    assert "EqualTo(event_type,cart)" in text
    assert "payload" not in text


def test_carts_may_be_counted_before_the_product_join(events, spark):
    """In a dense log the join gets one row per user and product instead of one per cart."""
    products = spark.range(101).selectExpr("concat('p', id) AS product_id", "concat('c', id % 7) AS category")
    dense = events.withColumn("user_id", F.concat(F.lit("u"), F.length("user_id").cast("string")))
    found = {eager: segments.primary_category(dense, products, eager=eager) for eager in (False, True)}
    assert sorted(found[True].collect()) == sorted(found[False].collect())
    carts = dense.where("event_type = 'cart'")
    pairs = carts.select("user_id", "product_id").distinct().count()
    assert pairs * 20 < carts.count()
    for eager in (True, False):
        text = plan(segments.primary_category(dense, products, eager=eager))
        below = text[text.index("Join"):]  # children come after their operator
        assert ("partial_count" in below) == eager


def test_hot_product_is_split_at_run_time(events, spark):
    products = spark.range(101).selectExpr("concat('p', id) AS product_id", "'A' AS category")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = segments.primary_category(events, products)
        users = found.count()
        result = found.groupBy().count()
        result.collect()
        assert "skew=true" in plan(result)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    carts = events.where("event_type = 'cart'")
    assert users == carts.select("user_id").distinct().count()


def test_building_a_query_runs_nothing(spark):
    """Neither a job nor a written table."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for query in registry.library_queries().values():
            query(spark, table_dir("0.001"))
        assert not tracker.getJobIdsForGroup("building")
        spark.range(1).collect()
        assert tracker.getJobIdsForGroup("building")  # a job would have been seen
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_attribute_join_adds_no_shuffle(events, spark):
    users = spark.range(997).selectExpr("concat('u', id) AS user_id", "'A' AS gender")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan(segments.segment_by_attribute(user_flags(events), users))
    finally:
        spark.conf.set(key, before)
    # users' flags, users' values, and the segments
    assert len(exchanges(text)) == 3


def test_readout_computes_the_facts_once(events):
    results = experiment.ab_results(user_facts(events))
    results.collect()
    final = plan(results).split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert final.count("ReusedExchange") >= 2


def test_readout_orders_aggregated_rows_only(events, tmp_path, spark):
    write_artifact(user_facts(events), str(tmp_path), "facts", "parquet")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    results = experiment.ab_results(facts)
    text = plan(results)
    assert "percentile" not in text.lower() and "median(" not in text
    for match in re.finditer(r"\n[^\n]*\+- Window \[", text):
        # Each window sits on counts: there is an aggregate between it and the scan.
        assert "HashAggregate" in text[match.end():]
    results.collect()
    assert "ReusedExchange" in plan(results), "the counts are computed once"


@pytest.mark.parametrize("name", sorted(registry.library_queries()))
def test_no_query_leaves_the_jvm_or_forms_all_pairs(spark, name):
    text = plan(registry.library_queries()[name](spark, table_dir("0.001")))
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text
