"""Readers, writers, views, intermediate tables and the batch job."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import published as pub
import reconstruction
from footfall import schema, sources
from footfall.operators import quality
from footfall.plans import analyses, query_library
from footfall.plans.job import run
from footfall.operators.funnel import funnel_wide
from footfall.operators.users import funnel_users, user_facts

HEADER = "event_id,user_id,product_id,event_type,event_timestamp,extra\n"


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_events_csv(spark, tmp_path):
    path = write_text(tmp_path / "events.csv", HEADER + (
        "1,u1,p1,view,2024-01-01 10:00:00,x\n"
        "2,u2,,cart,2024-01-01T10:00:00.123456,x\n"
        "3,NaN,p1,purchase,2024-01-02,x\n"
        '4,"",p1,NA,,x\n'
    ))
    events = sources.read_events(spark, path)
    assert events.schema["event_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert [tuple(r) for r in events.orderBy("event_id").collect()] == [
        ("1", "u1", "p1", "view", datetime(2024, 1, 1, 10)),
        ("2", "u2", None, "cart", datetime(2024, 1, 1, 10, 0, 0, 123456)),
        ("3", None, "p1", "purchase", datetime(2024, 1, 2)),
        ("4", None, "p1", None, None),
    ]
    assert tuple(quality.missing_keys(events).first()) == (2, 1, 1)


def test_columns_are_found_by_name(spark, tmp_path):
    path = write_text(
        tmp_path / "events.csv",
        "event_timestamp,event_type,user_id,product_id\n2024-01-01,view,u1,p1\n",
    )
    assert sources.read_events(spark, path).columns == [
        "user_id", "product_id", "event_type", "event_timestamp",
    ]
    path = write_text(tmp_path / "short.csv", "user_id,event_type\nu1,view\n")
    with pytest.raises(ValueError, match="event_timestamp"):
        sources.read_events(spark, path)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unparsable_timestamp_fails_the_read_and_is_counted(spark, tmp_path, ansi):
    path = write_text(tmp_path / "events.csv", HEADER + (
        "1,u1,p1,view,2024-01-01 10:00:00,x\n2,u1,p1,view,yesterday,x\n3,u1,p1,view,,x\n"
    ))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="does not parse: yesterday"):
            sources.read_events(spark, path).collect()
        raw = sources.read_raw_events(spark, path)
        assert tuple(quality.bad_timestamps(raw).first()) == (3, 1, 1)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_malformed_csv_fails(spark, tmp_path):
    path = write_text(tmp_path / "users.csv", 'user_id,gender\nu1,x,surplus,more\n')
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        sources.read_users(spark, path).collect()


def test_parquet_keeps_id_types_and_unifies_timestamps(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql(
        "SELECT 7L AS user_id, 1L AS product_id, 'view' AS event_type, "
        "TIMESTAMP_LTZ '2024-01-01 10:00:00' AS event_timestamp"
    ).write.parquet(path)
    events = sources.read_events(spark, path, "parquet")
    assert dict(events.dtypes)["user_id"] == "bigint"
    assert dict(events.dtypes)["event_timestamp"] == "timestamp_ntz"
    assert events.first().event_timestamp == datetime(2024, 1, 1, 10)
    with pytest.raises(ValueError):
        sources.read_events(spark, path, "avro")


def test_artifacts(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(sources.MissingArtifact, match="funnel_rates"):
        sources.read_artifact(spark, out, "funnel_rates")
    with pytest.raises(sources.MissingArtifact, match="no such"):
        sources.read_artifact(spark, out, "funnels")
    rates = spark.createDataFrame([("view_to_cart", 0.5, 50.0)], schema.FUNNEL_RATES)
    for fmt in ("csv", "parquet"):
        sources.write_artifact(rates, f"{out}/{fmt}", "funnel_rates", fmt)
        again = sources.read_artifact(spark, f"{out}/{fmt}", "funnel_rates", fmt)
        assert again.schema == schema.FUNNEL_RATES
        assert again.collect() == rates.collect()
    sources.write_artifact(rates.repartition(2), out, "funnel_rates", single_file=True)
    assert len(list((tmp_path / "funnel_rates").glob("part-*.csv"))) == 1


def test_write_events_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame(
        [("a", "view", datetime(2024, 1, d, h)) for d in (1, 2, 3) for h in range(24)],
        "user_id STRING, event_type STRING, event_timestamp TIMESTAMP_NTZ",
    ).repartition(8)
    sources.write_events(events, path)
    assert sorted(p.name for p in Path(path).glob("event_date=*")) == [
        f"event_date=2024-01-0{d}" for d in (1, 2, 3)
    ]
    back = spark.read.parquet(path)
    assert back.count() == 72
    assert back.where("event_date = DATE '2024-01-02'").count() == 24


def test_views(spark):
    events = spark.createDataFrame(
        [("a", "p", "view", datetime(2024, 1, 1)), ("a", "p", "cart", datetime(2024, 1, 9))],
        "user_id STRING, product_id STRING, event_type STRING, event_timestamp TIMESTAMP_NTZ",
    )
    users = spark.createDataFrame([("a", "x")], "user_id STRING, gender STRING")
    products = spark.createDataFrame([("p", "A")], "product_id STRING, category STRING")
    sources.register_views(events, users, products)
    row = spark.sql("""
        SELECT gender, category, count_if(week1_active) AS kept
        FROM user_facts JOIN users USING (user_id) JOIN events USING (user_id)
             JOIN products USING (product_id)
        WHERE event_type = 'cart' GROUP BY ALL""").first()
    assert tuple(row) == ("x", "A", 1)


def test_written_table_and_work_folder(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    with sources.work_folder(spark, "/elsewhere") as folder:
        assert Path(folder).is_relative_to(shared)
        table = sources.written_table(spark.range(5), "five", folder)
        assert table.count() == 5
        assert Path(folder, "five").is_dir()
    assert not Path(folder).exists()


def test_work_folder_without_a_setting_is_beside_the_results(spark, tmp_path):
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=spark.sparkContext)
    with sources.work_folder(session, str(tmp_path)) as folder:
        assert Path(folder).is_relative_to(tmp_path)


ROWS = [
    ("u1 ", 'a "quoted" name, with comma', "x"),
    (" u1", "two\nlines", "x"),
    ("u1", "back\\slash\\", "x"),
    ("", None, "x"),
]


def test_csv_keeps_what_it_is_given(spark, tmp_path):
    table = spark.createDataFrame(ROWS, schema.ASSIGNMENTS)
    sources.write_artifact(table, str(tmp_path), "experiment_assignments")
    back = sources.read_artifact(spark, str(tmp_path), "experiment_assignments")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ROWS, key=str)


@pytest.mark.parametrize("reader", ["read_users", "read_products", "read_events"])
def test_quoted_csv(spark, tmp_path, reader):
    names = {
        "read_users": "user_id,gender",
        "read_products": "product_id,category",
        "read_events": "user_id,product_id,event_type,event_timestamp",
    }[reader]
    n = names.count(",") + 1
    more = ["2024-01-01 00:00:00"] if reader == "read_events" else []
    cells = ['"12"" pans, steel"', '" two\nlines "', "back\\slash"][: n - len(more)]
    text = names + "\n" + ",".join([*cells, *more]) + "\n"
    path = write_text(tmp_path / "t.csv", text)
    row = tuple(getattr(sources, reader)(spark, path, multi_line=True).first())
    assert row[: len(cells)] == ('12" pans, steel', " two\nlines ", "back\\slash")[: len(cells)]


def test_short_row_fails_whichever_columns_are_read(spark, tmp_path):
    path = write_text(tmp_path / "users.csv", "user_id,gender,city,zip\nu1,x,a,b\nu2,y\n")
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        sources.read_users(spark, path).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_mean_the_same_in_every_session_zone(spark, tmp_path, zone):
    """Seven days less half an hour, over a change to daylight saving."""
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, zone)
    try:
        rows = [("u", "cart", "2024-03-08T12:00:00Z"), ("u", "purchase", "2024-03-15T11:30:00Z")]
        text = spark.createDataFrame(rows, "user_id string, event_type string, event_timestamp string")
        instants = text.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
        for events in (text, instants):
            found = user_facts(sources.prepare_events(events)).first()
            assert (found.week1_active, found.purchase_within_7d) == (False, True)
            assert found.first_cart_ts == datetime(2024, 3, 8, 12)
    finally:
        spark.conf.set(key, before)


def test_offsets_patterns_and_zones(spark):
    def read(text, **options):
        raw = spark.createDataFrame([(text,)], "event_timestamp string")
        return sources.parse_timestamps(raw, **options).first()[0]

    assert read("2024-01-01 10:00:00+05:00") == datetime(2024, 1, 1, 5)
    assert read("2024-01-01T10:00:00Z") == datetime(2024, 1, 1, 10)
    assert read("2024-01-01 10:00:00 Europe/Paris") == datetime(2024, 1, 1, 9)
    assert read("2024-01-01 10:00:00") == datetime(2024, 1, 1, 10)
    assert read("2024-01-01") == datetime(2024, 1, 1)
    assert read("2024-01-01 10:00:00", zone="America/New_York") == datetime(2024, 1, 1, 15)
    assert read("01/02/2024 10:00", pattern="dd/MM/yyyy HH:mm") == datetime(2024, 2, 1, 10)
    assert read("01/02/2024 10:00 +0200", pattern="dd/MM/yyyy HH:mm xx") == datetime(2024, 2, 1, 8)
    raw = spark.createDataFrame(
        [("2024-01-01 10:00:00Z",), ("2024-01-01 10:00",), ("junk",), (None,)], "event_timestamp string"
    )
    assert tuple(quality.timestamp_forms(raw).first()) == (1, 1)
    assert tuple(quality.bad_timestamps(raw).first()) == (4, 1, 1)


def csv_inputs(folder):
    def cell(value):
        return "" if value is None else str(value)

    events, users, products = reconstruction.build()
    for name, header, rows in (
        ("events", "user_id,product_id,event_type,event_timestamp", events),
        ("users", "user_id,gender", users),
        ("products", "product_id,category", products),
    ):
        lines = [header] + [",".join(map(cell, row)) for row in rows]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def job_output(spark, tmp_path_factory):
    in_dir, out_dir = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("processed")
    csv_inputs(in_dir)
    names = run(spark, str(in_dir), str(out_dir))
    return names, str(in_dir), str(out_dir)


def test_job_writes_all_artifacts(spark, job_output):
    names, _, out_dir = job_output
    assert names == list(schema.ARTIFACTS)

    def rows(name):
        return [tuple(r) for r in sources.read_artifact(spark, out_dir, name).collect()]

    assert rows("funnel_stages") == list(pub.STAGES.items())
    assert [(r[0], r[2]) for r in rows("funnel_rates")] == [
        (name, pct) for name, (_, pct) in pub.RATES.items()
    ]
    assert len(rows("funnel")) == 9
    assert [(r[0], *r[1:3], r[4]) for r in rows("cohort_retention")] == [
        (month, users, active, pct) for month, (users, active, _, pct) in pub.COHORTS.items()
    ]
    assert [(r[1], r[2], r[3], r[5]) for r in rows("segment_conversion")] == [
        (k, v[0], v[1], v[3]) for t in (pub.GENDERS, pub.CATEGORIES) for k, v in t.items()
    ]
    assert [(r[1], r[2], r[3], r[5], r[7]) for r in rows("ab_results_by_variant")] == [
        (k, v[0], v[1], v[3], v[6]) for k, v in pub.VARIANTS.items()
    ]
    (summary,) = rows("ab_results_summary")
    assert summary[-1] == pytest.approx(pub.SUMMARY["p_value_two_sided"], rel=1e-12)
    assignments = rows("experiment_assignments")
    assert len(assignments) == len({r[0] for r in assignments}) == pub.STAGES["cart"]


def test_job_leaves_no_intermediate_tables(spark, job_output):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "footfall"
    application = shared / spark.sparkContext.applicationId
    assert not list(application.glob("*/ab_results"))


def test_job_can_be_repeated(spark, job_output):
    _, in_dir, out_dir = job_output
    before = sources.read_artifact(spark, out_dir, "segment_conversion").collect()
    run(spark, in_dir, out_dir)
    assert sources.read_artifact(spark, out_dir, "segment_conversion").collect() == before


def test_query_library_conventions(spark, job_output):
    _, in_dir, _ = job_output
    events = sources.read_events(spark, f"{in_dir}/events.csv")
    users = sources.read_users(spark, f"{in_dir}/users.csv")
    products = sources.read_products(spark, f"{in_dir}/products.csv")
    dropoff = funnel_wide(funnel_users(events)).first().asDict()
    assert dropoff["view_users"] == pub.STAGES["view"]
    assert dropoff["cart_to_purchase_conversion_strict"] == pytest.approx(2313 / 6994)
    daily = query_library.cohort_retention_week1(events)
    assert daily.columns == [
        "cohort_month", "cohort_users", "week1_users", "week1_retention_rate",
    ]
    assert daily.first().cohort_month == "2024-01-04"
    segments = query_library.conversion_by_segment(events, users, products)
    assert segments.columns == [
        "segment_type", "segment_value", "cart_users", "purchased_users",
        "cart_to_purchase_conversion",
    ]
    assert segments.count() == 13
    trial = query_library.ab_test_primary_and_guardrails(analyses.user_facts(events))
    assert [r.success_users for r in trial.collect()] == [19, 18]
    built = analyses.build_ab_test(events)
    assert built.summary.first().z_stat == pytest.approx(pub.SUMMARY["z_stat"], rel=1e-10)
