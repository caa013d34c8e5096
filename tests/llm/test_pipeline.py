import corpus_pipeline
from freshet.llm import exact_dedup, near_dedup

from .test_operators import SCHEMA, rows


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "exact_dedup":
            assert exact_dedup.exact_dedup(docs).where("NOT kept").count() == 0
            assert docs.count() == docs.select("doc_id").distinct().count()
        if name == "near_dedup":
            assert near_dedup.near_duplicate_classes(docs).where("NOT kept").count() == 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)


def test_stages_on_nulls_ties_and_long_texts(spark, tmp_path):
    """Null labels and doc_ids, null and empty and very long texts, ties and repeats go through all five stages."""
    spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i}" for i in range(40_000))
    data = [(1, None, "a"), (2, "one two", None), (2, "one two", None), (None, "three four five six seven", "b"), (None, None, None), (5, "", "a"), (6, long, "b"), (7, long + " end", "b"), (8, "  \n", "a")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {2, None, 6} and all(r.n_tokens > 0 for r in rows)
