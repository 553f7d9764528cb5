"""Rows that share a doc_id and have different texts."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import jaccard_join, substring_dedup


def passage(seed, n=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


A, B, C = passage(1), passage(2), passage(3)


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs.withColumn("twin", F.lit("own"))).collect())


def test_substrings_leave_what_repeats_nowhere(spark):
    got = removed(spark, [(0, A), (1, A), (1, B)])
    assert got == sorted([(0, A, 60, 0), (1, "", 60, 60), (1, B, 60, 0)])


def test_equal_rows_are_one_document(spark):
    got = removed(spark, [(0, A), (2, B), (2, B), (3, B)])
    assert got == sorted([(0, A, 60, 0), (2, B, 60, 0), (2, B, 60, 0), (3, "", 60, 60)])


def test_substrings_against_brute_force(spark):
    """Each (doc_id, text) is a document, in the order of the text's hash."""
    draw = random.Random(4)
    parts = [passage(10 + i, 30) for i in range(6)]
    rows = sorted({(draw.randrange(8), " ".join(draw.choice(parts) for _ in range(draw.randrange(1, 5)))) for _ in range(40)})
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted((r.doc_id, r.h, r.text) for r in hashed)
    want = brute.substring([(i, t) for i, (_, _, t) in enumerate(order)])
    got = {(d, t): (n, less) for d, t, n, less in removed_by_text(spark, rows)}
    assert got == {(d, t): want[i][:2] for i, (d, _, t) in enumerate(order)}


def removed_by_text(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text")).repartition(3)
    return [(r.doc_id, r.was, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect()]


def test_the_stage_leaves_what_repeats_nowhere(spark):
    docs = spark.createDataFrame([(0, A, 1), (1, A, 1), (1, B, 1)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.substrings(spark, docs, "").collect()) == sorted([(0, A), (1, ""), (1, B)])


def test_components_join_rows_of_one_doc_id(spark):
    rows = [(0, A), (1, A), (1, B), (2, B), (3, C), (3, ""), (4, None), (4, C)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.text_component) for r in jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 56, 0, 0), (1, 56, 0, 0), (1, 56, 0, 1), (2, 56, 0, 1), (3, 0, 3, 3), (3, 56, 3, 3), (4, 0, 4, 4), (4, 56, 3, 3)]


def test_components_against_brute_force(spark):
    """A document is all rows of its doc_id; every link of one of them is its link."""
    draw = random.Random(6)
    texts = [passage(20 + i) for i in range(12)]
    texts += [t.rsplit(" ", 2)[0] + " other end" for t in texts[:6]]
    rows = [(draw.randrange(25), draw.choice(texts)) for _ in range(40)]
    sets = [(d, brute.shingles(t)) for d, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    root = brute.roots({d for d, _ in rows}, links)
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, root[d]) for d, _ in rows)


def test_the_stage_judges_rows_by_their_own_text(spark):
    docs = spark.createDataFrame([(0, A), (1, A), (1, B), (2, B), (5, C), (5, C)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(0, A), (1, B), (5, C)])
