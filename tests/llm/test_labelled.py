"""The classifiers where only a part of the labels is learnt from."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import labelled, quality_model, toxicity


@pytest.fixture(scope="module", params=[7, 2], ids=["both labels fill the sample", "half of the rarer label"])
def table(spark, tmp_path_factory, request):
    """40,000 labelled documents; 18 % (or 8 %) are toxic and as many bad, and their words tell it most of the time."""
    rng = random.Random(request.param)
    rare = 0.18 if request.param == 7 else 0.08
    plain = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40_000):
        y = rng.random() < rare
        told = rng.random() < (0.85 if y else 0.1)
        rows.append((i, " ".join([*rng.choices(plain, k=7), "## vile !" if told else "some."]), int(y), int(not y)))
    path = str(tmp_path_factory.mktemp("labelled"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").repartition(4).cache()
    df.select("doc_id", "text").write.parquet(f"{path}/documents.parquet")
    df.select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("op, label", [(toxicity.op1_toxicity, "toxic"), (quality_model.op6_quality_classifier, "quality")])
def test_scores_follow_the_shares_of_all_labels(spark, table, op, label):
    """Beyond the sample's size accuracy and mean score stay those of the labels' own shares."""
    known = spark.read.parquet(f"{table}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    r = op(spark, table).where("held_out").join(known, "doc_id").agg(
        F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("right"), F.avg("score").alias("score"), F.avg(F.col("y").cast("double")).alias("y"),
        F.avg(F.col("predicted").cast("double")).alias("predicted"),
    ).first()
    assert r.right > 0.84
    assert abs(r.score - r.y) < 0.04
    assert 0.02 < r.predicted < 0.98


def test_the_sample_has_both_labels_and_knows_their_shares(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.col("doc_id").cast("string").alias("text"))
    learnt = labels.where(~labelled.held_out()).groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in learnt}
    for most, want in ((100, (50, 50)), (1000, (1000 - n[1], n[1])), (5000, (n[0], n[1]))):
        rows, shift = labelled.sample(docs, labels, "toxic", most, str)
        got = tuple(sum(y == k for y, _ in rows) for k in (0, 1))
        assert got == want and all((int(t) % 5 == 0) == y for y, t in rows)
        assert abs(shift - math.log(want[0] * n[1] / (n[0] * want[1]))) < 1e-9
