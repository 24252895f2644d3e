"""Every registered query against its SQL in DuckDB, on the smallest tables.

Jobs that train on climate values need months without gaps, which only the next size has.
"""

import duckdb
import pytest

from helpers import sorted_rows
from scarpline.queries import oracle_sql, queries
from scarpline.queries.base import TABLES

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
LARGER = dict.fromkeys(
    ["climate_workflow_closed", "stability_by_year", "forecast_dataset", "forecast_run_summary"], "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for folder in (SF, *set(LARGER.values())):
        connection.execute(f"CREATE SCHEMA \"{folder}\"; USE \"{folder}\"")
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    folder = LARGER.get(name, SF)
    result = queries()[name](spark, folder)
    duck.execute(f"USE \"{folder}\"")
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    expected = sorted_rows(cursor.fetchall(), names)
    assert sorted_rows(result.collect(), result.columns) == expected
