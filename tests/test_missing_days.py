"""Days without a row and days whose value is NULL, in the registered queries and in their SQL."""

import datetime as dt
import math

import duckdb
import pytest

from freshet import plans


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A site with rows on 1, 2, 4, 5 and 6 January; the values of 2 and 5 January are NULL (o_orderkey % 11 = 0)."""
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [(key, 7, 500.0, dt.datetime(2000, 1, day)) for key, day in ((1, 1), (11, 2), (2, 4), (22, 5), (3, 6))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def both(spark, folder, name, *columns):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES[name](spark, folder).select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(con.execute(f"SELECT {listed} FROM ({plans.ORACLE_SQL[name]})").fetchall())
    return got


def test_days_without_a_value_are_missing(spark, orders):
    assert [d.day for _, d in both(spark, orders, "j3_missing_days", "site_id", "date")] == [2, 3, 5]


def test_ranges_hold_days_without_a_value(spark, orders):
    columns = ("site_id", "start", "end", "days")
    assert [(a.day, b.day, n) for _, a, b, n in both(spark, orders, "w2_missing_ranges", *columns)] == [(2, 3, 2), (5, 5, 1)]
    assert [(a.day, b.day, n) for _, a, b, n in both(spark, orders, "w2_absent_ranges", *columns)] == [(3, 3, 1)]


def test_days_with_a_null_value_are_present_in_the_calendar(spark, orders):
    assert both(spark, orders, "a3_calendar", "expected", "present", "missing") == [(6, 5, 1)]
    assert both(spark, orders, "site_profile", "n", "n_finite", "expected", "present", "missing") == [(5, 3, 6, 5, 1)]


def test_elasticity_of_one_complete_year_is_that_of_the_sql(spark, tmp_path):
    """One complete water year: its departures from the mean are 0, and SQL divides them to NaN."""
    days = [dt.datetime(1999, 10, 1) + dt.timedelta(days=i) for i in range(366)]
    rows = [(7, 2.0 + i % 5, 0.01 * (i % 7), day) for i, day in enumerate(days)] + [(40, 3.0 + y + i % 3, 0.02 * (i % (3 + y)), day + dt.timedelta(days=366 * y)) for y in range(2) for i, day in enumerate(days[: 366 - y])]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_tax double, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")  # with more, its sums differ in the last place from one scan to the next
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {r.site_id: r for r in plans.QUERIES["a8_runoff_ratio"](spark, str(tmp_path)).collect()}
    said = {r[0]: r for r in con.execute(f"SELECT site_id, n_years, runoff_ratio, elasticity FROM ({plans.ORACLE_SQL['a8_runoff_ratio']})").fetchall()}
    assert math.isnan(got["0"].elasticity) and math.isnan(said["0"][3]) and got["0"].n_years == 1
    assert tuple(got["0"])[:3] == said["0"][:3] and (got["1"].n_years, got["1"].runoff_ratio, got["1"].elasticity) == said["1"][1:]
