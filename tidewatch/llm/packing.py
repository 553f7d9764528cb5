"""Best-fit packing by a grouping genetic algorithm on islands with migrating elites."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, tokens

#: Tokens in a sequence.
CAPACITY = 1024
#: Pieces that are packed together; a fixed share of them, whatever the number of all pieces.
SHARD_ITEMS = 32_768
#: Sequences of one full piece are numbered from here, behind those of all shards.
FULL = 1 << 62
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 3, 2, 6, 4, 1


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document of more than ``capacity`` ids (its end id included) is cut so that only its first
    piece is shorter. Null texts are empty and have their end id alone. Repeated rows and rows with
    a null doc_id stay as rows of their own. Other columns are ignored.
    """
    common.prepare(docs.sparkSession)

    def pieces(batches):
        for batch in batches:
            rows = []
            for doc_id, ids in zip(tokens.column(batch, "doc_id"), tokens.with_end(batch.column("text"), vocabulary), strict=True):
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(common.released(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins by what is left in them; best fit takes the fullest that has room."""

    def __init__(self, capacity: int, left: np.ndarray):
        self.capacity, self.n = capacity, len(left)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        for b, r in enumerate(left.tolist()):
            if r:
                self.stacks[r].append(b)
                self.open |= 1 << r

    def put(self, size: int) -> int:
        """Place one item; returns its bin."""
        fits = self.open >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            stack = self.stacks[r]
            b = stack.pop()
            if not stack:
                self.open &= ~(1 << r)
        else:
            r, b = self.capacity, self.n
            self.n += 1
        if r > size:
            self.stacks[r - size].append(b)
            self.open |= 1 << (r - size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items taken in the order given."""
    out, bins = np.zeros(len(sizes), np.int32), Bins(capacity, np.zeros(0, np.int64))
    out[order] = [bins.put(s) for s in sizes[order].tolist()]
    return out


def renumbered(bins: np.ndarray) -> np.ndarray:
    """The same bins, numbered from 0 without gaps."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def refill(sizes: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the items marked in ``out`` among the bins of the others, larger items first."""
    bins = bins.copy()
    bins[~out] = renumbered(bins[~out])
    n = int(bins[~out].max(initial=-1)) + 1
    left = capacity - np.bincount(bins[~out], sizes[~out], n).astype(np.int64)
    holder = Bins(capacity, left)
    moved = np.flatnonzero(out)
    moved = moved[np.argsort(-sizes[moved], kind="stable")]
    bins[moved] = [holder.put(s) for s in sizes[moved].tolist()]
    return bins


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject some of b's best-filled bins whole into a.

    Bins of a that share an item with them go; the rest of their items is displaced and best-fitted.
    """
    fill = np.bincount(b, sizes).astype(np.int64)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(full, max(1, len(full) // 4), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    displaced = hit[a] & ~injected
    child = a.astype(np.int64)
    child[injected] = b[injected] + len(hit)
    return refill(sizes, renumbered(child), displaced, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Empty the least filled bins and a few others, and best-fit their items."""
    fill = np.bincount(bins, sizes)
    worst = np.argsort(fill)[: max(1, len(fill) // 50)]
    gone = np.zeros(len(fill), bool)
    gone[worst] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    return refill(sizes, bins, gone[bins], capacity)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(number of bins, minus the mean squared fill): smaller is better."""
    fill = np.bincount(bins, sizes) / capacity
    return len(fill), -float(np.mean(fill**2))


def evolve(sizes: np.ndarray, start: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """A population after some generations, best first. Stops when no packing can be smaller."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    population = list(start)
    while len(population) < POPULATION:
        # decreasing order, disturbed more for each further member
        key = sizes * (1 + 0.02 * len(population) * rng.standard_normal(len(sizes))) if population or seed % ISLANDS else sizes
        population.append(best_fit(sizes, np.argsort(-key, kind="stable"), capacity))
    key = lambda x: fitness(sizes, x, capacity)
    population.sort(key=key)
    for _ in range(GENERATIONS):
        if key(population[0])[0] <= least:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        child = mutate(sizes, crossover(sizes, population[min(i, j)], population[max(i, j)], capacity, rng), capacity, rng)
        population = sorted([*population, child], key=key)[:POPULATION]
    return population


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``pieces`` (a written table, as it is read several times) with sequence_id and offset.

    Pieces are dealt by hash to shards of about ``shard_items``, so no shard grows with the input and
    a hot source is spread. Each shard is packed on ISLANDS islands; after each epoch an island's
    elites go to the next one, and in the end the best packing of a shard is taken. Full pieces are
    sequences of their own and are in no shard. An empty table gives an empty result; pieces longer than ``capacity``
    are not allowed.
    """
    spark = pieces.sparkSession
    shards = -(-max(1, pieces.where(F.col("length") < capacity).count()) // shard_items)
    small = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    wide = max(1, min(shards * ISLANDS, common.partitions(spark)))

    def sizes_of(key, group: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(group["length"].to_numpy(np.int32))[::-1]
        return pd.DataFrame({"shard": [key[0]], "sizes": [sizes.astype("<i4").tobytes()]})

    sizes = small.select("shard", "length").groupBy("shard").applyInPandas(sizes_of, "shard int, sizes binary")
    state = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.array().cast("array<binary>").alias("members"))

    for epoch in range(EPOCHS):

        def live(frames, epoch=epoch):
            for frame in frames:
                out = []
                for shard, island, raw, members in zip(frame["shard"], frame["island"], frame["sizes"], frame["members"], strict=True):
                    sizes = np.frombuffer(raw, "<i4").astype(np.int64)
                    population = evolve(sizes, [np.frombuffer(m, "<i4") for m in members], capacity, (int(shard) * EPOCHS + epoch) * ISLANDS + int(island))
                    out.append((shard, island, raw, [m.astype("<i4").tobytes() for m in population]))
                yield pd.DataFrame(out, columns=["shard", "island", "sizes", "members"])

        lived = common.saved(state.repartition(wide, "shard", "island").mapInPandas(live, "shard int, island int, sizes binary, members array<binary>"), "islands")
        guests = lived.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("members", 1, ELITES).alias("guests"))
        state = lived.join(guests, ["shard", "island"]).select("shard", "island", "sizes", F.concat("guests", F.slice("members", 1, POPULATION - ELITES)).alias("members"))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        found = [np.frombuffer(m[0], "<i4") for m in right.sort_values("island")["members"]]
        lengths = left["length"].to_numpy()
        bins = min(found, key=lambda x: fitness(lengths, x, capacity)).astype(np.int64)
        left = left.assign(bin=bins)
        left["offset"] = left.groupby("bin")["length"].cumsum() - left["length"]
        left["sequence_id"] = (int(key[0]) << 40) + left["bin"]
        return left[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = small.groupBy("shard").cogroup(lived.groupBy("shard")).applyInPandas(best, schema)
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(packed.columns))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(common.saved(cut(common.read(spark, sf_dir, "documents"), tokens.vocabulary_path()), "pieces"))
