"""What the operators share: tables, checkpoints, word hashes and a bounded repeat filter."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at a time; texts are long.
BATCH_ROWS = 1000
#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20
#: The repeat filter's slots. Its size is fixed: it is broadcast.
SLOT_BITS = 28
#: Keys are counted by their upper FINE_BITS, so that two of them rarely count as one; a slot covers 2 ** (FINE_BITS - SLOT_BITS) of these places.
FINE_BITS = 36
#: Ranges that the slots are cut into; a task works through one after another.
RANGES = 1024
#: Keys that a task packs at a time.
PACKED = 1 << 22
#: A slot counted fewer times is never listed as frequent.
FREQUENT = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep batches of long texts small, have a checkpoint folder, and ship this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    context = spark.sparkContext
    if getattr(context, "_tidewatch_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the archive from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/tidewatch.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((top / "tidewatch").rglob("*.py")):
            z.write(p, p.relative_to(top))
    context.addPyFile(archive)
    context._tidewatch_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one of our own where none is set, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read again: cuts lineage, survives lost executors.

    The folder stays until the driver ends, so texts are packed closely.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    swept(spark)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of jobs that are over, and the driver give back what memory it freed.

    Spark does so once the driver's garbage is collected, which else happens when the heap is full, however full the disks are.
    The plans and task reports of a few dozen jobs are garbage enough to grow the heap to its limit; whole collections shrink it again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _give_back()


def _give_back() -> None:
    """Have this process's allocators return what nothing holds any more."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def released(f):
    """``f``, a function over batches, giving what memory it freed back to the system when its task ends.

    Workers are kept for later tasks, and allocators keep what those tasks may never need again.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def unused(name: str, taken: list[str]) -> str:
    """The name, or a longer one that no column has."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- word hashes

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_WHITE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))
_STEP = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array):
    """(first row, offsets, bytes) of runs of texts of about SLICE_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, at[first : last + 1] - at[first], whole[at[first] : at[last]]
        first = last


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """(document, start, end, 64-bit hash) of each run of bytes other than the six ASCII white-space ones."""
    n, docs = len(data), len(offsets) - 1
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none, np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    inside = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(start) == 0:
        return none, none, none, np.zeros(0, np.uint64)
    power, longest = _POWERS, int((end - start).max())
    if longest > len(power):
        power = np.cumprod(np.full(longest, _BASE, np.uint64))
    span = np.diff(start, append=n)
    place = np.arange(n) - start[0]
    place = place[start[0] :] - np.repeat(start - start[0], span)
    np.minimum(place, len(power) - 1, out=place)  # white space behind a word; it counts 0
    h = np.add.reduceat(_BYTE[data[start[0] :]] * power[place], start - start[0])
    doc = np.searchsorted(offsets, start, "right") - 1
    return doc, start, end, mix(h + (end - start).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k hashes; one for each start that has k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _STEP[0]
    for j in range(1, k):
        total = total + mix(h[j : j + n] + np.uint64(j)) * _STEP[j]
    return mix(total)


# ------------------------------------------------- keys that occur repeatedly

COUNTS_SCHEMA = "bucket int, gaps binary, n int"


def packed_slots(places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of COUNTS_SCHEMA: sorted places, repeats included, as gaps of seven bits a byte (the eighth: more follows)."""
    places = np.sort(places.astype(np.int64))
    edges = _edges(buckets)
    cut = np.searchsorted(places, edges)
    rows: list[tuple[int, bytes, int]] = []
    for b in range(buckets):
        own = places[cut[b] : cut[b + 1]]
        if len(own):
            rows.append((b, _packed(np.diff(own, prepend=edges[b])), len(own)))
    kinds = [pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["bucket", "gaps", "n"])


def _edges(buckets: int) -> np.ndarray:
    """Where the ranges of places begin and end: at edges of slots."""
    return ((np.arange(buckets + 1, dtype=np.int64) << SLOT_BITS) // buckets) << (FINE_BITS - SLOT_BITS)


def _packed(gaps: np.ndarray) -> bytes:
    size = np.ones(len(gaps), np.int64)
    for bits in range(7, FINE_BITS + 1, 7):
        size += gaps >= 1 << bits
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(int(size.max())):
        own = np.flatnonzero(size > j)
        out[begin[own] + j] = ((gaps[own] >> (7 * j)) & 127) | np.where(size[own] > j + 1, 128, 0)
    return out.tobytes()


def _unpacked(gaps: bytes, low: int) -> np.ndarray:
    raw = np.frombuffer(gaps, np.uint8)
    last = raw < 128
    begin = np.flatnonzero(np.r_[True, last[:-1]])
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(begin, append=len(raw)))
    return low + np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin))


def slot_buckets(spark: SparkSession) -> int:
    """Ranges that the slots are cut into: enough to keep what a task counts at once to a few MB."""
    return max(partitions(spark), RANGES)


def slot(h: np.ndarray) -> np.ndarray:
    """The slot of each hash: its upper bits."""
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fine(h: np.ndarray) -> np.ndarray:
    """The place at which each hash is counted."""
    return (h >> np.uint64(64 - FINE_BITS)).astype(np.int64)


def slot_counts(packed: DataFrame, buckets: int, most_frequent: int = 0):
    """A bitmap of the slots that hold a place counted at least twice, and at most ``most_frequent`` of the most frequent slots with the counts of their fullest places.

    ``packed`` has COUNTS_SCHEMA rows. Only keys that repeat fill the bitmap, so it tells the others apart until those that repeat,
    and not all there are, come near 2 ** SLOT_BITS. Each bucket covers its own range and a task works through
    one bucket after another, so what it holds are the places of one range in a thousand. What reaches the driver
    is 2 ** SLOT_BITS bits, compressed, and ``most_frequent`` counts, whatever the input's size.
    """
    spark = packed.sparkSession
    edges = _edges(buckets)
    extra = FINE_BITS - SLOT_BITS

    def counted(b: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        places, n = np.unique(np.concatenate(parts), return_counts=True)
        places, n = places[n >= 2] >> extra, n[n >= 2]
        total = np.zeros((edges[b + 1] - edges[b]) >> extra, np.int32)
        np.maximum.at(total, places - (edges[b] >> extra), n.astype(np.int32))
        bits = zlib.compress(np.packbits(total >= 2, bitorder="little").tobytes(), 1)
        top = np.flatnonzero(total >= FREQUENT) if most_frequent else np.zeros(0, np.int64)
        if len(top) > most_frequent:
            top = top[np.argpartition(total[top], -most_frequent)[-most_frequent:]]
        values = [b], [bits], [(top + (edges[b] >> extra)).astype("<u4").tobytes()], [total[top].astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "bits", "slots", "counts"])

    def count(batches):
        held, parts = None, []
        for batch in batches:
            for b, gaps in zip(batch.column("bucket").to_pylist(), batch.column("gaps"), strict=True):
                if b != held:
                    if held is not None:
                        yield counted(held, parts)
                    held, parts = b, []
                parts.append(_unpacked(gaps.as_py(), edges[b]))
        if held is not None:
            yield counted(held, parts)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    done = packed.repartition(min(buckets, partitions(spark)), "bucket").sortWithinPartitions("bucket").mapInArrow(released(count), "bucket int, bits binary, slots binary, counts binary")
    seen = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    top = np.zeros((0, 2), np.uint32)
    for row in done.collect():
        low, high = (row.bucket << SLOT_BITS) // buckets, ((row.bucket + 1) << SLOT_BITS) // buckets
        bits = np.unpackbits(np.frombuffer(zlib.decompress(row.bits), np.uint8), bitorder="little")[: high - low]
        first, last = low // 8 * 8, -(-high // 8) * 8
        whole = np.zeros(last - first, np.uint8)
        whole[low - first : high - first] = bits
        seen[first // 8 : last // 8] |= np.packbits(whole, bitorder="little")
        own = np.stack([np.frombuffer(row.slots, np.uint32), np.frombuffer(row.counts, np.uint32)], 1)
        top = _largest(np.concatenate([top, own]), most_frequent)
    prepare(spark)
    frequent = top[np.argsort(top[:, 0])]
    return seen, frequent[:, 0].astype(np.int64), frequent[:, 1].astype(np.int64)


def _largest(rows: np.ndarray, most: int) -> np.ndarray:
    if len(rows) <= most:
        return rows
    # all slots with the same count stay or go together
    least = np.partition(rows[:, 1], -most)[-most]
    return rows[rows[:, 1] > least]


def repeated(seen: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots the bitmap has."""
    return (seen[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


# --------------------------------------------------------- connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge; one row each.

    Large-star and small-star steps in turn: each hooks nodes to the smallest neighbour, so the
    number of rounds grows with the logarithm of a component's size. They end once the edges are stars: no node
    hangs on two others, and none that hangs on one has others hanging on it. The edges never leave the
    cluster; each round is checkpointed to the shared folder. A null end drops the edge.
    """
    spark = edges.sparkSession
    prepare(spark)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    e = e.checkpoint()
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        swept(spark)
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(e.select("v", F.lit(0), F.lit(1)))
        # one that hangs on two nodes, or hangs and holds others, is no star's
        ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if ends.where(F.col("hangs") + F.col("holds") > 1).agg(F.count("*")).first()[0] == 0:
            break
    return nodes.join(e, nodes.node == e.u, "left").select("node", F.coalesce("v", "node").alias("component"))
