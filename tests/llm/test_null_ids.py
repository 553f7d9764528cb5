"""Rows without a doc_id, and rows that repeat one."""

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import binary_output, tokens

WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [(None, "no id"), (None, None), (3, "three"), (-1, "minus one"), (3, "three")]


def test_binary_output_of_rows_without_an_id(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (d, _), x in zip(rows, brute.token_ids([t for _, t in rows], tokens.vocabulary_path())):
        want.append((start, d, len(x), brute.crc(x)))
        start += len(x)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_output.op9_binary_output(spark, str(tmp_path)).collect()) == want


def test_near_duplicates_keep_rows_without_an_id_and_one_of_equal_rows(spark):
    rows = [(1, WORDS), (1, WORDS), (2, WORDS), (4, None), (4, None), (5, "other words"), (None, WORDS), (None, "x")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, WORDS), (4, None), (5, "other words"), (None, WORDS), (None, "x")]))
