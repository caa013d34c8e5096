"""Live feeds of (site_id, ts, value, approval): daily means, newest approval, exceedance episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(readings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Mean and number of a site's readings by day; rows later than the watermark are dropped. Batch or stream."""
    rows = readings.withWatermark("ts", lateness) if readings.isStreaming else readings
    days = rows.where("value IS NOT NULL").groupBy("site_id", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return days.select("site_id", F.to_date("w.start").alias("date"), "mean", "n")


def distinct_readings(readings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each reading and approval state once."""
    keys = ["site_id", "ts", "approval"]
    return readings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if readings.isStreaming else readings.dropDuplicates(keys)


def newest_state(readings: DataFrame) -> DataFrame:
    """Of a reading's states the approved one, else the provisional one."""
    rank = F.when(F.col("approval") == "A", 1).otherwise(0)
    top = readings.groupBy("site_id", "ts").agg(F.max(F.struct(rank.alias("rank"), "approval", "value")).alias("r"))
    return top.select("site_id", "ts", F.col("r.approval").alias("approval"), F.col("r.value").alias("value"))


def upsert(table_path: str):
    """A foreachBatch function that keeps the newest state of each reading in Parquet, one version folder a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v={batch_id - 1}")
        there = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
        rows = newest_state(batch)
        if there:
            rows = newest_state(rows.unionByName(spark.read.schema(rows.schema).parquet(f"{table_path}/v={batch_id - 1}")))
        rows.write.mode("overwrite").parquet(f"{table_path}/v={batch_id}")

    return write


def episodes(readings: DataFrame, threshold: float, gap: str = "2 hours", lateness: str = "2 days") -> DataFrame:
    """Stretches of readings above a threshold with less than `gap` between them."""
    rows = readings.withWatermark("ts", lateness) if readings.isStreaming else readings
    above = rows.where(F.col("value") > threshold)
    g = above.groupBy("site_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return g.select("site_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")
