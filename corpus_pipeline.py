"""The corpus pipeline: quality classifier, exact dedup, near-dedup, source mixing, tokenisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, exact_dedup, mixing, near_dedup, quality
from freshet.llm.common import cut, table
from freshet.sources.scratch import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; rejected ones go.

    Null and empty texts share the score of no words; without labels every score is 0.5 and all stay. Rows without a doc_id,
    repeated rows and rows of one doc_id are each judged by their own text; scores at the threshold stay. An empty table
    stays empty.
    """
    return quality.quality_scores(docs, table(spark, sf_dir, "labels"), keep_columns=True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of each row's own in the order of doc_id (rows without one last), written so that it stays."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    dealt = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose number is a doc_id of kept: no doc_id, and one that other texts have too, are no reason to go."""
    return rows.join(kept.select(F.col("doc_id").alias("_row")).hint("merge"), "_row", "left_semi").drop("_row")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the longest and of those the one of the least doc_id; of equal rows one.

    Null and empty texts are one group. Rows without a doc_id come last in the order, and stay if their text is alone.
    """
    rows = numbered(docs)
    return keep_rows(rows, exact_dedup.exact_dedup(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that of the least doc_id; rows without one come last in the order.

    Null and empty texts are one class; other texts without words are equal only if identical.
    """
    rows = numbered(docs)
    return keep_rows(rows, near_dedup.near_duplicate_classes(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each document and pass that takes of it, with the words taken.

    Null and empty texts have no words and are never drawn. A null source is a source of its own. Repeated rows are drawn
    as rows of their own.
    """
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every whole text; a document that the mix takes several times is encoded each time.

    Null texts count as empty and have no tokens; rows without a doc_id stay.
    """
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("tokenise", tokenise)]

#: SQL cannot express the classifier, the near-duplicates or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
