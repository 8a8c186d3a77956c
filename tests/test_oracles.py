"""Every registered query against its SQL counterpart, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from compare import duck, duck_rows, spark_rows
from conftest import TABLES, table_dir

QUERIES = registry.library_queries()
ORACLES = registry.library_oracle_sql()


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def scale(request):
    sf_dir = table_dir(request.param)
    connection = duck(sf_dir, TABLES)
    yield sf_dir, connection
    connection.close()


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, scale, name):
    sf_dir, connection = scale
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = duck_rows(connection, ORACLES[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry(spark):
    assert registry.entry(spark).count() == 1
