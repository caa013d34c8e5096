"""Series documents, location collections, attribute tables, texts, and the model input layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SERIES = "site_id string, schema string, dates array<string>, values array<double>, q_cms array<double>, value_column string, variable string, product string, source string, units string, timestep string, approval_codes array<string>, qualifier_codes array<string>, other_columns map<string, array<double>>"
FEATURES = "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<double>>>>"
TEXT_FILES = "*.{txt,md,rst}"


def series_documents(documents: DataFrame) -> DataFrame:
    """Retained series (arrays) to long rows: site_id, date, value, units, approval, qualifier.

    Values may be named values or, of old, q_cms, which without units are m3/s. Codes are kept only if there is one for
    each date. Non-finite values are NULL.
    """
    values, n = F.coalesce("values", "q_cms"), F.size("dates")
    units = F.coalesce("units", F.when(F.col("values").isNull() & F.col("q_cms").isNotNull(), "m3/s"))
    codes = lambda c: F.when(F.size(c) == n, F.col(c))
    rows = documents.select("site_id", "dates", values.alias("v"), units.alias("units"), codes("approval_codes").alias("a"), codes("qualifier_codes").alias("q"))
    each = rows.select("site_id", "units", "v", "a", "q", F.posexplode("dates").alias("i", "d"))
    return each.select("site_id", S.day_of(F.col("d")).alias("date"), S.finite(F.get("v", "i")).alias("value"), "units", F.get("a", "i").alias("approval"), F.get("q", "i").alias("qualifier"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return series_documents(spark.read.schema(SERIES).json(path, multiLine=True))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature of GeoJSON collections: id, properties, lon, lat."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.id", "f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def read_attributes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Semicolon tables (path to its schema, first column gauge_id as text) joined by normalised gauge id."""
    padded = F.when(F.length(F.trim("gauge_id")) < 8, F.lpad(F.trim("gauge_id"), 8, "0")).otherwise(F.trim("gauge_id"))
    tables = [spark.read.schema(schema).csv(path, sep=";", header=True).withColumn("gauge_id", S.attribute_gauge(padded)) for path, schema in paths.items()]
    return reduce(lambda a, b: a.join(b, "gauge_id", "full"), tables)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, text: one row a text file; bytes that are no UTF-8 become the replacement character, other files are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", TEXT_FILES).option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("doc_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_forcing_csv(forcing: DataFrame, path: str) -> None:
    """One folder of CSV for each site."""
    forcing.repartition("site_id").sortWithinPartitions("site_id", "date").write.mode("overwrite").partitionBy("site_id").option("header", True).csv(path)


def _fixed(*columns: str) -> list:
    return [F.format_string("%.3f", c).alias(c) for c in columns]


def summa_layout(forcing: DataFrame) -> DataFrame:
    """year, month, day, hour 12, then those of precipitation, temperature, radiation and wind that there are."""
    names = [c for c in ("prcp_mm", "tavg_C", "srad_Wm2", "wind_ms") if c in forcing.columns]
    return forcing.select("site_id", F.col("date").alias("_d"), F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.lit(12).alias("hour"), *_fixed(*names))


def vic_layout(forcing: DataFrame) -> DataFrame:
    """Precipitation, greatest and least temperature, wind; the order of days is the only key."""
    return forcing.select("site_id", F.col("date").alias("_d"), *_fixed("prcp_mm", "tmax_C", "tmin_C", "wind_ms"))


def write_layout(rows: DataFrame, path: str, header: bool) -> None:
    """Tab-separated, one folder and one file for each site, in the order of days."""
    rows.repartition("site_id").sortWithinPartitions("site_id", "_d").drop("_d").write.mode("overwrite").partitionBy("site_id").option("sep", "\t").option("header", header).csv(path)


def write_passages(passages: DataFrame, path: str, rebuild: bool = True) -> None:
    """The passage index as JSON lines: built anew, or with passages added whose hash it does not have yet."""
    rows = passages
    if not rebuild:
        rows = passages.join(read_passages(passages.sparkSession, path).select("passage_hash"), "passage_hash", "left_anti")
    rows.write.mode("overwrite" if rebuild else "append").json(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("passage_hash string, doc_name string, chunk_idx int, text string").json(path)


def served_csv(series: DataFrame) -> DataFrame:
    return series.select("site_id", "date", F.col("value").alias("q_cms"))


def write_served_csv(series: DataFrame, path: str) -> None:
    """date,q_cms for each site; a missing value is an empty cell."""
    served_csv(series).repartition("site_id").sortWithinPartitions("site_id", "date").write.mode("overwrite").partitionBy("site_id").option("header", True).option("nullValue", "").csv(path)
