"""What stages leave on disk and send over it."""

import os

import corpus_pipeline
from tidewatch.llm import common


def test_near_duplicates_deal_texts_out_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other", "z")], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        exchanges = [line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line]
        rows = kept.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, rows)) == [(1, "a b c d e f", "x"), (3, "other", "z")]
    assert exchanges and not any("text#" in line for line in exchanges)


def test_saved_tables_are_packed_closely(spark):
    path = common.saved(spark.range(10), "packed").inputFiles()[0]
    assert os.path.basename(path).endswith(".zstd.parquet")
