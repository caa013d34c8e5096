"""Queries over feeds and file layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import shared_folder
from ..streaming import feeds
from .registry import daily, gappy, instants, passages, query, read, sites
from .series import rounded


def place(spark, name):
    """A new folder among the shared ones."""
    return f"{shared_folder(spark)}/freshet/{name}-{uuid.uuid4().hex}"


def readings(spark, d):
    """Events as instantaneous values, with an approval state."""
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("site_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.when(F.col("event_id") % 3 == 0, "A").otherwise("P").alias("approval"))


@query("r1_daily_means", "SELECT site_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS mean, count(*) AS n FROM instants WHERE value IS NOT NULL GROUP BY ALL")
def r1(spark, d):
    return rounded(feeds.daily_means(readings(spark, d)), "mean")


@query("r2_newest_state", "SELECT site_id, ts, arg_max(value, k) AS value, arg_max(approval, k) AS approval FROM (SELECT CAST(user_id AS VARCHAR) AS site_id, date_trunc('hour', ts) AS ts, value, CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'P' END AS approval, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, value) AS k FROM events) GROUP BY ALL")
def r2(spark, d):
    hourly = readings(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return feeds.newest_state(hourly).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("r3_episodes", "SELECT site_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n, max(value) AS peak FROM (SELECT *, sum(s) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY site_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM instants WHERE value > 20)) GROUP BY site_id, e")
def r3(spark, d):
    return feeds.episodes(readings(spark, d), 20.0).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("io1_series_documents", "SELECT site_id, date, value, 'm3/s' AS units, CASE WHEN site_id <> 'g1' THEN 'A' END AS approval FROM gappy")
def io1(spark, d):
    s = gappy(spark, d).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("r"))
    docs = s.select("site_id", F.transform("r", lambda x: x["date"].cast("string")).alias("dates"), F.lit(None).cast("array<double>").alias("values"), F.transform("r", lambda x: x["value"]).alias("q_cms"), F.lit(None).cast("string").alias("units"), F.when(F.col("site_id") != "g1", F.array_repeat(F.lit("A"), F.size("r"))).otherwise(F.array(F.lit("A"))).alias("approval_codes"), F.lit(None).cast("array<string>").alias("qualifier_codes"))
    return files.series_documents(docs).drop("qualifier")


def forcing(spark, d):
    s = daily(spark, d)
    return s.select("site_id", "date", (F.col("value") / 100).alias("prcp_mm"), (F.col("prcp") * 30).alias("tmax_C"), (F.col("prcp") * 20).alias("tmin_C"), (F.col("prcp") * 25).alias("tavg_C"), F.lit(2.0).alias("wind_ms"))


@query("io6_summa_layout", "SELECT site_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, 12 AS hour, printf('%.3f', value / 100) AS prcp_mm, printf('%.3f', prcp * 25 + 1e-9) AS tavg_C, '2.000' AS wind_ms FROM daily")
def io6(spark, d):
    f = forcing(spark, d).withColumn("tavg_C", F.col("tavg_C") + 1e-9)
    return files.summa_layout(f).drop("_d")


@query("io7_vic_layout", "SELECT site_id, printf('%.3f', value / 100) AS prcp_mm, printf('%.3f', prcp * 30 + 1e-9) AS tmax_C, printf('%.3f', prcp * 20 + 1e-9) AS tmin_C, '2.000' AS wind_ms FROM daily")
def io7(spark, d):
    f = forcing(spark, d).withColumns({c: F.col(c) + 1e-9 for c in ("tmax_C", "tmin_C")})
    return files.vic_layout(f).drop("_d")


@query("io9_served_csv", "SELECT site_id, date, value AS q_cms FROM gappy")
def io9(spark, d):
    return files.served_csv(gappy(spark, d))


@query("io2_features", "SELECT gauge_id AS id, name, lon, lat FROM sites")
def io2(spark, d):
    path = place(spark, "io2")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("coordinates"))
    feature = F.struct(F.col("gauge_id").alias("id"), F.create_map(F.lit("name"), "name").alias("properties"), point.alias("geometry"))
    pages = sites(spark, d).withColumn("page", F.floor(F.col("gauge_id").cast("int") / 20)).groupBy("page").agg(F.collect_list(feature).alias("features"))
    pages.select("features").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_features(spark, path).select("id", F.element_at("properties", "name").alias("name"), "lon", "lat")


@query("io3_attributes", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS gauge_id, CASE WHEN s_nationkey < 20 THEN s_acctbal END AS area, CASE WHEN s_nationkey >= 10 THEN s_nationkey END AS zone FROM supplier")
def io3(spark, d):
    s, folder = read(spark, d, "supplier"), place(spark, "io3")
    s.where("s_nationkey < 20").select(F.col("s_suppkey").alias("gauge_id"), F.col("s_acctbal").alias("area")).write.option("sep", ";").option("header", True).csv(f"{folder}/a")
    s.where("s_nationkey >= 10").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("gauge_id"), F.col("s_nationkey").alias("zone")).write.option("sep", ";").option("header", True).csv(f"{folder}/b")
    return files.read_attributes(spark, {f"{folder}/a": "gauge_id string, area double", f"{folder}/b": "gauge_id string, zone int"})


@query("io4_texts", "SELECT sha256(string_agg(o_orderkey || ' ' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS digest, count(*) AS n_lines FROM orders GROUP BY o_orderpriority")
def io4(spark, d):
    path = place(spark, "io4")
    rows = read(spark, d, "orders").repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    rows.select("o_orderpriority", F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("value")).write.partitionBy("o_orderpriority").text(path)
    return files.read_texts(spark, path).select(F.sha2("text", 256).alias("digest"), F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"))


@query("io5_forcing_csv", "SELECT site_id, date, value / 100 AS prcp_mm FROM daily")
def io5(spark, d):
    path = place(spark, "io5")
    files.write_forcing_csv(forcing(spark, d).select("site_id", "date", "prcp_mm"), path)
    return spark.read.schema("date date, prcp_mm double, site_id string").option("header", True).csv(path).select("site_id", "date", "prcp_mm")


@query("io8_passages", "SELECT substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS passage_hash, min(doc_name) AS doc_name FROM docs_ GROUP BY 1")
def io8(spark, d):
    from ..functions import scalars as S

    path = place(spark, "io8")
    p = passages(spark, d).select(S.text_hash(F.col("text")).alias("passage_hash"), "doc_name", F.lit(0).alias("chunk_idx"), "text")
    first = p.groupBy("passage_hash").agg(F.min_by(F.struct("doc_name", "chunk_idx", "text"), "doc_name").alias("x")).select("passage_hash", "x.*")
    files.write_passages(first.where("doc_name < '5'"), path)
    files.write_passages(first, path, rebuild=False)
    return files.read_passages(spark, path).select("passage_hash", "doc_name")
