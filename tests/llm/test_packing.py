"""Full pieces do not go through the shards."""

from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import common, packing


def test_full_pieces_are_sequences_without_a_shard(spark):
    rows = [(1, k, 10 + 1024 * k, 1024, k) for k in range(1, 3000)] + [(d, 0, 0, 100 + d, d) for d in range(2, 60)] + [(None, 1, 5, 1024, 9)] * 2
    pieces = common.saved(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    packed = packing.pack(pieces)
    got = packed.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    held = defaultdict(int)
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 1024 and len(held) == 3001 + -(-sum(100 + d for d in range(2, 60)) // 1024)
    full = packed.where(F.col("length") == 1024)
    assert full.where(F.col("sequence_id") < packing.FULL).count() == 0 and full.where("offset != 0").count() == 0
    assert packing.pack(common.saved(pieces.where("length = 1024"), "pieces")).count() == 3001
