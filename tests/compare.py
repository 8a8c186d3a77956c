"""Value comparison of a Spark result and a DuckDB result."""

from __future__ import annotations

import duckdb


def duck(sf_dir: str, tables) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in tables:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _order(row):
    return [(value is not None, str(type(value)), value if value is not None else 0) for value in row]


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([row[n] for n in names] for row in df.collect()), key=_order)


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([row[i] for i in order] for row in rows), key=_order)
