"""The repeat filter is filled by what repeats, not by all there is."""

import random

import numpy as np

from tidewatch.llm import common, jaccard_join


def test_gaps_round_trip():
    rng = np.random.default_rng(4)
    places = np.r_[rng.integers(0, 1 << common.FINE_BITS, 5000), 0, 0, (1 << common.FINE_BITS) - 1, np.arange(300) + 77]
    packed = common.packed_slots(places, 1000)
    found = [common._unpacked(g.as_py(), common._edges(1000)[b]) for b, g in zip(packed.column(0).to_pylist(), packed.column(1), strict=True)]
    assert (np.concatenate(found) == np.sort(places)).all()
    assert sum(packed.column(2).to_pylist()) == len(places)


def test_single_shingles_do_not_fill_the_filter(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(1000)) for _ in range(1000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "text string").repartition(4)
    common.prepare(spark)
    ranges = common.slot_buckets(spark)
    seen, _, _ = common.slot_counts(jaccard_join.count_slots(docs, ranges), ranges)
    # a million single shingles share some 1,900 of 2 ** 28 slots by chance; the 996 of the text written twice count
    assert 990 <= int(np.unpackbits(seen).sum()) <= 1200
