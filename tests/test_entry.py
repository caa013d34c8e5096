"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from freshet import plans

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["site_profile", "a6_agreement", "w2_missing_ranges", "a26_stage_lookup", "t13_lineage", "j6_neighbours"])
def test_columns_and_rows_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "supplier", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(plans.ORACLE_SQL[name]).fetchdf()
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns) and got.count() == len(want)
