"""Where queries and their SQL are registered, and the adapters from the driver's tables to keyed series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH " + ", ".join(VIEWS[v] for v in VIEWS if v in _needed(sql)) + ("" if not _needed(sql) else " ") + sql if _needed(sql) else sql
        return f

    return add


#: SQL twins of the adapters below.
VIEWS = {
    "daily": "daily AS (SELECT CAST(l_suppkey // 33 AS VARCHAR) AS site_id, CAST(l_shipdate AS DATE) AS date, round(sum(l_quantity), 2) AS value, round(sum(l_tax), 4) AS prcp FROM lineitem GROUP BY ALL)",
    "gappy": "gappy AS (SELECT 'g' || CAST(o_custkey // 300 AS VARCHAR) AS site_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN min(o_orderkey) % 11 = 0 THEN NULL ELSE floor(sum(o_totalprice) + 0.001) / 1000 END AS value FROM orders GROUP BY ALL)",
    "m": "m AS (SELECT site_id, count(value) AS n, median(value) AS med, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (value <= 0) AS z FROM gappy GROUP BY site_id)",
    "instants": "instants AS (SELECT CAST(user_id AS VARCHAR) AS site_id, ts, value, event_type FROM events)",
    "cells": "cells AS (SELECT CAST(p_size % 4 AS VARCHAR) AS basin_id, CAST(p_partkey // 50 AS INTEGER) AS \"row\", CAST(p_partkey % 50 AS INTEGER) AS col, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE round(p_retailprice / 100 - 9, 3) END AS hand, CAST(p_size AS INTEGER) AS lulc, p_brand AS brand, p_partkey AS id, p_retailprice AS price FROM part)",
    "sites": "sites AS (SELECT CAST(s_suppkey AS VARCHAR) AS gauge_id, s_name AS name, (s_suppkey * 37 % 3600) / 10.0 - 180 AS lon, (s_suppkey * 53 % 1600) / 10.0 - 80 AS lat, s_acctbal AS area FROM supplier)",
    "passages": "docs_ AS (SELECT CAST(doc_id AS VARCHAR) AS doc_name, coalesce(text, '') AS text FROM documents)",
}


def _needed(sql: str) -> list[str]:
    import re

    names = [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN) {'docs_' if v == 'passages' else v}\b", sql)]
    return [*names, "gappy"] if "m" in names and "gappy" not in names else names


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flow (value) and precipitation (prcp); a site is 33 suppliers, so sites grow with the table."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.floor(F.col("l_suppkey") / 33).cast("string").alias("site_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("value"), F.round(F.sum("l_tax"), 4).alias("prcp"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with missing days and NULL values; a site is 300 customers, so sites grow with the table."""
    rows = read(spark, sf_dir, "orders")
    value = F.when(F.min("o_orderkey") % 11 != 0, F.floor(F.sum("o_totalprice") + 0.001) / 1000)
    return rows.groupBy(F.concat(F.lit("g"), F.floor(F.col("o_custkey") / 300).cast("string")).alias("site_id"), F.to_date("o_orderdate").alias("date")).agg(value.alias("value"))


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("site_id"), "ts", "value", "event_type")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells with height above drainage, land cover and population-like columns."""
    k = F.col("p_partkey")
    hand = F.when(k % 17 != 0, F.round(F.col("p_retailprice") / 100 - 9, 3))
    return read(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("string").alias("basin_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), hand.alias("hand"), F.col("p_size").cast("int").alias("lulc"), F.col("p_brand").alias("brand"), k.alias("id"), F.col("p_retailprice").alias("price"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.cast("string").alias("gauge_id"), F.col("s_name").alias("name"), ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 53 % 1600) / 10.0 - 80).alias("lat"), F.col("s_acctbal").alias("area"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.coalesce("text", F.lit("")).alias("text"))
