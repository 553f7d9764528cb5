"""The stages leave columns alone that have the names of their own, and take odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F
from tidewatch.llm import common

NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "votes", "base_failed", "posterior", "kept"]


def test_quality_keeps_columns_of_any_name(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    odd = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    got = corpus_pipeline.quality(spark, odd, "")
    rows = got.collect()
    assert got.columns == odd.columns and {r.doc_id for r in rows} == want
    assert all(r[c] == f"own {c}" for r in rows for c in NAMES)
    assert corpus_pipeline.quality(spark, odd.limit(0), "").count() == 0


ALL = [*NAMES, "score", "n_removed", "key", "gone", "_row", "_first", "component_id", "n_shingles", "sequence_id", "piece", "_"]


def test_every_stage_on_odd_rows(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing names, no rows."""
    prose = " ".join(f"quiet{i % 97} river{i % 89} stone{i % 83} runs, and the {i} green hills stay." for i in range(60))
    odd = [(1, prose), (1, prose), (2, prose + " End."), (None, prose), (3, None), (4, ""), (None, None), (5, " ".join(f"w{i}e." for i in range(40_000))), (6, "short text")]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ALL])
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name == "pack":
            assert out.where("doc_id = 5").count() > 1 and out.count() > docs.count()
            continue
        rows = out.collect()
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in ALL)
        kept[name] = [(r.doc_id, r.text) for r in rows]
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    alone = sorted(((d, t) for d, t in odd if d not in (1, 2)), key=key)
    assert sorted(kept["near_duplicates"], key=key) == sorted([*alone, (1, prose)], key=key)
    assert len(kept["substrings"]) == len(odd)
    assert {t for d, t in kept["quality"] if d in (3, 4, 6)} == set()
