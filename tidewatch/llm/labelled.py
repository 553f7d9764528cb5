"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

import math
import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common


def held_out() -> Column:
    """Documents whose labels are not learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, of_text) -> tuple[list[tuple], float]:
    """(label, of_text(text)) of at most ``most`` labelled documents that are not held out, and what to add
    to the log odds of label 1 that such rows teach.

    They are the ones of least hash of the id, so the choice does not follow the order of ids; the rarer
    label is taken up to half of the sample. Where that leaves out more of one label than of the other, the
    sample has not the shares of all labels: the second value, the log of the share that is taken of label 0
    over that of label 1, brings the odds back to them. It is 0 where all are taken. What ``of_text`` returns has to be bounded, as the driver
    gathers it. Rows with a null id, label or text are left out; of a document with both labels, 1 counts.
    """
    common.prepare(docs.sparkSession)
    known = labels.where(~held_out()).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counted = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n = [counted.get(y, 0) for y in (0, 1)]
    rarer = int(n[1] < n[0])
    take = [0, 0]
    take[rarer] = min(n[rarer], most // 2)
    take[1 - rarer] = min(n[1 - rarer], most - take[rarer])
    sides = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[y]) for y in (0, 1) if take[y]]
    chosen = sorted((r["h"], r["doc_id"], r["y"]) for s in sides for r in s.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y").collect())
    if not chosen:
        return [], 0.0
    shift = math.log(take[0] * n[1] / (n[0] * take[1])) if all(take) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast({d for _, d, _ in chosen})

    def pick(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [i for i, d in enumerate(ids) if d in shared.value]
            texts = batch.column(1).take(pa.array(own, pa.int64())).to_pylist()
            out = [(ids[i], pickle.dumps(of_text(t))) for i, t in zip(own, texts, strict=True) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["doc_id", "parts"])

    ids = docs.sparkSession.createDataFrame([(d,) for _, d, _ in chosen], "doc_id long")
    # at most ``most`` ids: small enough to be sent to all executors
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = {r["doc_id"]: r["parts"] for r in near.mapInArrow(pick, "doc_id long, parts binary").collect()}
    return [(y, pickle.loads(found[d])) for _, d, y in chosen if d in found], shift
