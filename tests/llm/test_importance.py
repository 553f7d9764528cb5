"""Importance resampling against a plain version; the query has SQL, too (test_oracles)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import common, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:]))]], len(w)


def plain(docs, target, share=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank) of each document."""
    seen, wanted = Counter(), Counter()
    for counter, texts in ((seen, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            counter.update(plain_features(t)[0])
    s, t = seen.total(), wanted.total()
    gain = {k: math.floor(1000 * math.log((wanted[k] + 1) * (s + 10000) / ((seen[k] + 1) * (t + 10000)))) for k in {*seen, *wanted}}
    rows = []
    for d, text in docs:
        f, words = plain_features(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[5]))
    for rank, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def made(n, seed):
    draw = random.Random(seed)
    letters = ["a", "B", " ", "é", "한국", "x1 ", " ", "_", "\x00", "z" * 30, "中" * 30, "\n"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 150))) for _ in range(n)]


def test_buckets_of_all_features():
    texts = [None, "", " ", "a", "é", *made(500, 3), "w" * 100_000 + " a " + "v" * 64 + " " + "u" * 65]
    for first, offsets, data in common.slices(pa.array(texts, pa.string())):
        doc, bucket, words = importance.features(offsets, data)
        for i in range(len(offsets) - 1):
            f, n = plain_features(texts[first + i])
            assert sorted(bucket[doc == i].tolist()) == sorted(f) and words[i] == n


def test_against_a_plain_version(spark):
    """Repeated and missing ids, null and empty texts, ties, clashing names."""
    texts = [None, "", "short", *made(120, 4)]
    docs = [*enumerate(texts), (None, texts[10]), (None, texts[11]), (5, texts[5]), (5, texts[5]), (7, texts[30])]
    target = [*made(20, 9), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("score", "rank", "weight", "_row", "n_words")]).repartition(5)
    for share, least in ((25, 20), (100, 0), (0, 5), (33, 1)):
        got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), share, least)
        assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
        key = lambda r: tuple((x is not None, x or 0) for x in r)
        rows = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]
        assert sorted(rows, key=key) == sorted(plain(docs, target, share, least), key=key)


def test_ranks_where_a_third_of_all_rows_tie(spark):
    rows = [(i if i % 3 else 0, 5 if i % 3 else 40, i % 11 if i % 3 else 7) for i in range(600)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(6)
    got = importance.ranked(scored, 50, 10).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 101)) and len(got) == 600
    assert all(r.n_words == 40 for r in got if r["rank"] is not None)
    whole = [r["rank"] for r in sorted(importance.ranked(scored, 100, 0).collect(), key=lambda r: (-r.score, r.doc_id, -r.n_words, r["rank"]))]
    assert whole == list(range(1, 601))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = {r.doc_id: (r.n_features, r.weight) for r in importance.resample(some, none).collect()}
    assert got == {d: (n, w) for d, n, w, _, _ in plain([(1, "one two three"), (2, None)], [])}
    assert importance.counts(none, "text").tolist() == [0] * importance.BUCKETS


def test_gains_are_exact():
    corpus, target = np.array([0, 5, 9] + [0] * 9997), np.array([1, 0, 9] + [0] * 9997)
    got = importance.gains(corpus, target)
    assert got[:3].tolist() == [math.floor(1000 * math.log(2 * 10014 / (1 * 10010))), math.floor(1000 * math.log(1 * 10014 / (6 * 10010))), math.floor(1000 * math.log(10 * 10014 / (10 * 10010)))]
