"""Registry hygiene, and (with -m oracle) every query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "attempts_per_recovery" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.oracle
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    text, ok = compare(spark, con, name, SF)
    assert ok, text
