"""Importance resampling towards a target: hashed n-gram counts of corpus and target, weights, and a draw without replacement.

Two passes over the texts as Arrow batches. The first counts the features of each partition by bucket
(``np.bincount``), and ``treeReduce`` adds these vectors up, so that neither a task nor the driver ever holds more
than a few of them. The gains of all buckets, a vector of fixed size, are broadcast; the second pass looks each feature's
gain up and sums them by document (``np.bincount`` with weights). Scores are ranked by ranges, so no task sorts all rows.

A feature is a run of one or two consecutive words; its bucket is the crc32 of its UTF-8 bytes modulo BUCKETS. Checksums are
taken for all words of a batch at once: a crc is an exclusive or over its bytes, each by its distance from the end, and the
crc of two words together follows from those of both.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

BUCKETS = 10_000
#: Of the documents with at least MIN_WORDS words SHARE of 100 are drawn; SEED goes into each document's noise.
SHARE, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of a word up to which its crc comes from tables; longer ones are taken one by one.
LONGEST = 64
#: Partition vectors are added up in rounds of about the square root of their number.
DEPTH = 2


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of each byte by its distance from the end, crc of as many zero bytes, four tables a length that move a crc on by it)."""
    zero = np.array([zlib.crc32(bytes(n)) for n in range(LONGEST + 1)], np.uint32)
    byte = np.zeros((LONGEST, 256), np.uint32)
    for n in range(LONGEST):
        byte[n] = [zlib.crc32(bytes([b]) + bytes(n)) ^ int(zero[n + 1]) for b in range(256)]
    moved = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for n in range(LONGEST + 1):
        still = zlib.crc32(bytes(n), 0)
        for k in range(4):
            moved[n, k] = [zlib.crc32(bytes(n), b << 8 * k) ^ still for b in range(256)]
    return byte, zero, moved


_BYTE, _ZERO, _MOVED = _tables()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, letters and the bytes of all characters beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
#: What a crc becomes by one more blank.
_BLANK = zlib.crc32(b" ")


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What of a crc is left behind ``by`` more bytes, LONGEST at most."""
    out = _MOVED[by, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= _MOVED[by, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every feature and the number of words of each document, of texts in UTF-8 one behind another."""
    docs = len(offsets) - 1
    none = np.zeros(0, np.int64)
    data = _LOWER[data]
    inside = np.r_[False, _INSIDE[data], False]
    # a word ends where its text does
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    if len(start) == 0:
        return none, none, np.zeros(docs, np.int64)
    size = end - start
    short = np.minimum(size, LONGEST)
    # behind a word comes what is in none; it counts nothing
    span = np.diff(start, append=len(data))
    far = np.repeat(end - 1, span) - np.arange(start[0], len(data))
    share = np.where((far >= 0) & (far < LONGEST), _BYTE[np.clip(far, 0, LONGEST - 1), data[start[0] :]], np.uint32(0))
    one = np.bitwise_xor.reduceat(share, start - start[0]) ^ _ZERO[short]
    long = np.flatnonzero(size > LONGEST)
    for i in long.tolist():
        one[i] = zlib.crc32(data[start[i] : end[i]])
    doc = np.searchsorted(offsets, start, "right") - 1
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    before = _moved(one[follows], np.ones(len(follows), np.int64)) ^ np.uint32(_BLANK)
    two = _moved(before, short[follows + 1]) ^ one[follows + 1]
    for i in np.flatnonzero(size[follows + 1] > LONGEST).tolist():
        second = follows[i] + 1
        two[i] = zlib.crc32(data[start[second] : end[second]], int(before[i]))
    return np.r_[doc, doc[follows]], (np.r_[one, two] % np.uint32(BUCKETS)).astype(np.int64), np.bincount(doc, minlength=docs)


def counts(texts: DataFrame, column: str) -> np.ndarray:
    """How many features of all texts are in each bucket; null texts have none, repeated rows count each time."""
    common.prepare(texts.sparkSession)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, offsets, data in common.slices(batch.column(0)):
                total += np.bincount(features(offsets, data)[1], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    vectors = texts.select(column).mapInArrow(common.released(count), "total binary").rdd.map(lambda r: np.frombuffer(r.total, np.int64))
    return vectors.treeReduce(lambda a, b: a + b, DEPTH) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, rounded down; each bucket counts one more than was seen."""
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y + 1) * float(s + BUCKETS)) / (float(x + 1) * float(t + BUCKETS)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_features, n_words, weight: the mean gain of a document's features, rounded down; 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh_all(batches):
        for batch in batches:
            parts = [np.zeros((0, 3), np.int64)]
            for _, offsets, data in common.slices(batch.column(1)):
                doc, bucket, words = features(offsets, data)
                n = np.bincount(doc, minlength=len(words))
                # whole numbers far below 2 ** 53: the sums are exact
                total = np.bincount(doc, shared.value[bucket], len(words)).astype(np.int64)
                parts.append(np.stack([n, words, total // np.maximum(n, 1)], 1))
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(3)]], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.released(weigh_all), "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable drawn by the document's id, rounded down: adding it to log weights draws without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, share: int = SHARE, least: int = MIN_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score and others) with rank: 1, 2, 3 ... for the ``share`` of 100 of highest score, null for others.

    Only documents of at least ``least`` words are drawn; ties go to the smaller doc_id (null first), of rows with
    one doc_id to the one with more words. Rows are dealt by ranges of the score into one table; how many
    rows the ranges before hold gives each range its first rank. What ties after all this differs in nothing but
    where it stood, which deals ties of any number over several ranges, too.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("n_words"), F.asc("_row")]
    fit = F.col("n_words") >= least
    table = common.saved(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    drawn = table.where(fit).repartitionByRange(common.partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    drawn = common.saved(drawn, "ranges")
    # one row for each range
    sizes = drawn.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    some = drawn.join(F.broadcast(starts), "_part").withColumn("rank", place.cast("long"))
    some = some.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("_all") * share / 100), F.col("rank")))
    rest = table.where(~fit | fit.isNull()).withColumn("rank", F.lit(None).cast("long"))
    return some.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Weigh ``docs`` (doc_id, text) by likeness to ``target`` (text) and draw: doc_id, n_features, n_words, weight, score, rank.

    Null, empty and wordless texts have no features, weight 0 and are not drawn where ``least`` is above 0. Repeated rows are
    documents of their own, as are rows without a doc_id, which share one noise. Empty tables give no rows; without a target all
    buckets are as likely. Other columns are left out, whatever their names.
    """
    gain = gains(counts(docs, "text"), counts(target, "text"))
    return ranked(weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), share, least)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by their likeness to the benchmark's texts, and a quarter drawn: doc_id, n_features, weight, score, rank."""
    found = resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
