"""Shared pieces of the training-data operators: scratch tables, bounded hot keys, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: ASCII white space as the contracts spell it: space and 0x09 to 0x0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/freshet/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that `cut` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/freshet/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; it does so when the driver's memory is collected."""
    spark._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the session's own setting afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(counts: DataFrame, keys: list[str], n: str, rows: int, least: int = 1000, share: int = 1000) -> DataFrame:
    """Keys with at least rows/share rows. No more than `share` keys can have that many, so this may be broadcast."""
    return counts.where(F.col(n) >= max(least, rows // share)).select(*keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, salt_on: str, salts: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join of big to small (one row a key), hot keys of big dealt over `salts` partitions.

    The join shuffles both sides at every size, so that it costs alike for each row. hot: bounded (see hot_keys). salt_on: a column of big that differs between rows of one key. salts: by default as
    many as there are shuffle partitions, 64 at least.
    """
    salts = salts or max(64, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(marked, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right.hint("merge"), [*keys, "_salt"], how)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one array, and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty segments give 0."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out
