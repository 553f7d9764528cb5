"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of all of them, so the leading coordinates hold most of any
product. Those of one label are cut into tiles by their first coordinate; two tiles whose boxes lie too
far apart are never compared. In a pair of tiles products are summed a few coordinates at a time; what
is left of a product is at most the product of the suffix norms, and a pair is dropped as soon as even
that cannot bring it to the threshold. Survivors get their cosine in double precision from the vectors
as given. A comparison reports counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

THRESHOLD = 0.93
TILE = 1024
#: A tile of long vectors has fewer of them: no more components in all than these.
TILE_COMPONENTS = 1 << 19
#: Tiles that are sent to a comparison together.
BLOCK = 8
#: Coordinates after which pairs are dropped, as shares of all.
STEPS = (0.125, 0.25, 0.5)
#: Leading coordinates whose ranges make a tile's box.
BOX = 6
SLACK = 1e-9


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of components the sum of outer products of the unit vectors: its square is all the driver gets."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _matrices(batch.column(0)):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                d = x.shape[1]
                total[d] = total.get(d, np.zeros((d, d))) + unit.T @ unit
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], ["d", "place", "value"])

    rows = vectors.select("embedding").mapInArrow(add, "d int, place int, value double").groupBy("d", "place").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["d"], np.zeros((r["d"], r["d"]))).flat[r["place"]] = r["value"]
    return out


def _matrices(column: pa.Array):
    """The vectors of a column, those with the same number of components together."""
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths):
        own = column.take(pa.array(np.flatnonzero(lengths == d)))
        yield own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


TILES = "label string, d int, block long, tile long, low array<double>, high array<double>, ids binary, copies binary, given binary"


def _stretches(batch: pa.RecordBatch):
    """((label, d), ids, copies, vectors) of neighbouring rows with the same label and number of components."""
    at = 0
    for key, rows in itertools.groupby(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
        n = sum(1 for _ in rows)
        ids, copies = (batch.column(c).slice(at, n).to_numpy() for c in (0, 3))
        yield key, ids, copies, batch.column(2).slice(at, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        at += n


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in coordinates of the principal axes."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes


def tiles(vectors: DataFrame, shared, size: int, block: int) -> DataFrame:
    """Packed tiles of (id, label, embedding, copies), cut along the first coordinate of each label.

    Up to ``block`` neighbouring tiles of a label are a block. ``shared`` is the broadcast of the axes.
    """
    spark = vectors.sparkSession

    def turn(batches):
        for batch in batches:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            first = np.zeros(len(lengths))
            for d, x in zip(np.unique(lengths), _matrices(column), strict=True):
                first[lengths == d] = (x @ shared.value[int(d)][:, 0]) / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), pa.array(first)], ["id", "label", "embedding", "copies", "d", "first"])

    turned = vectors.select("id", "label", "embedding", "copies").mapInArrow(turn, "id long, label string, embedding array<double>, copies long, d int, first double")
    ordered = turned.repartitionByRange(common.partitions(spark), "label", "d", "first").sortWithinPartitions("label", "d", "first", "id")

    def cut(batches):
        part = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        key, n_tiles, n_blocks, in_block = None, 0, 0, 0

        def packed():
            nonlocal held, n_tiles, n_blocks, in_block
            ids, copies, x = (np.concatenate(c) for c in zip(*held, strict=True))
            n_blocks += in_block == 0
            n_tiles, in_block, held = n_tiles + 1, (in_block + 1) % block, []
            y = _turned(x, shared.value[key[1]])[:, :BOX]
            row = {"label": key[0], "d": key[1], "block": part + n_blocks, "tile": part + n_tiles, "low": y.min(0).tolist(), "high": y.max(0).tolist()}
            return pa.RecordBatch.from_pylist([row | {"ids": ids.tobytes(), "copies": copies.tobytes(), "given": x.tobytes()}], _TILE_SCHEMA)

        for batch in batches:
            for own, *columns in _stretches(batch):
                if own != key:
                    if held:
                        yield packed()
                    key, in_block = own, 0
                most = max(1, min(size, TILE_COMPONENTS // own[1]))
                while len(columns[0]):
                    room = most - sum(len(h[0]) for h in held)
                    held.append(tuple(c[:room] for c in columns))
                    columns = [c[room:] for c in columns]
                    if sum(len(h[0]) for h in held) == most:
                        yield packed()
        if held:
            yield packed()

    return ordered.mapInArrow(cut, TILES)


_TILE_SCHEMA = pa.schema([("label", pa.string()), ("d", pa.int32()), ("block", pa.int64()), ("tile", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *[(k, pa.binary()) for k in ("ids", "copies", "given")]])


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of unit vectors whose product may reach the threshold."""
    d = a.shape[1]
    after = [np.sqrt(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]) for x in (a, b)]
    after = [np.c_[x, np.zeros(len(x))] for x in after]
    steps = sorted({max(1, int(d * s)) for s in STEPS} | {d})
    total, done, i = np.zeros((len(a), len(b))), 0, None
    for to in steps:
        if i is None:
            total += a[:, done:to] @ b[:, done:to].T
            alive = total + after[0][:, to, None] * after[1][None, :, to] >= threshold - SLACK
            n = int(alive.sum())
            if n == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n * 20 < alive.size:  # few enough to follow one by one
                i, j = np.nonzero(alive)
                total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a[i, done:to], b[j, done:to])
            alive = total + after[0][i, to] * after[1][j, to] >= threshold - SLACK
            i, j, total = i[alive], j[alive], total[alive]
        done = to
    return np.nonzero(alive) if i is None else (i, j)


def linked(ids, copies, given, turned, same: bool, threshold: float):
    """(id, links of it found here, smallest id it is connected with here) for two tiles, or one with itself."""
    i, j = close_pairs(turned[0], turned[1], threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        s = slice(at, at + 100_000)
        x, y = given[0][i[s]], given[1][j[s]]
        keep[s] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold
    i, j = i[keep], j[keep]
    nodes = ids[0] if same else np.concatenate(ids)
    j = j if same else j + len(ids[0])
    weight = copies[0] if same else np.concatenate(copies)
    n = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
    root = nodes.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    hit = n > 0
    return nodes[hit], n[hit].astype(np.int64), root[hit]


def _gap(one, two):
    """Squared distance between two boxes, given as columns of lowest and highest coordinates."""
    apart = [F.greatest(a - d, c - b, F.lit(0.0)) for a, b, c, d in zip(*one, *two, strict=True)]
    return sum((x * x for x in apart), F.lit(0.0))


def links(tiled: DataFrame, shared, threshold: float) -> DataFrame:
    """(id, n, root) from every pair of tiles that may hold a link.

    A task of the comparison holds two blocks at a time, so a tile is sent once for each block near its
    own and not once for each tile. Blocks are paired by their boxes alone, tiles within them likewise.
    """
    far = 2 - 2 * threshold + SLACK
    # with fewer components than BOX the rest of a box is null, and no gap
    edge = lambda f, c, k: F.coalesce(f(F.get(c, F.lit(k))), F.lit(0.0)).alias(f"{c}{k}")
    boxes = tiled.groupBy("label", "d", "block").agg(*[edge(F.min, "low", k) for k in range(BOX)], *[edge(F.max, "high", k) for k in range(BOX)])
    sides = [[[F.col(f"{s}.{c}{k}") for k in range(BOX)] for c in ("low", "high")] for s in "ab"]
    pairs = boxes.alias("a").join(boxes.alias("b"), ["label", "d"]).where((F.col("a.block") <= F.col("b.block")) & (_gap(*sides) <= far))
    pairs = pairs.select(F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sent = pairs.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")).join(tiled.drop("label"), "block")
    spark = tiled.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a tile
    met = sent.repartition(common.partitions(spark), "one", "two").sortWithinPartitions("one", "two", "block", "tile")
    met = met.select("one", "two", "block", "d", "low", "high", "ids", "copies", "given")

    def compare(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        for (one, two), group in itertools.groupby(rows, key=lambda r: (r["one"], r["two"])):
            held: dict[int, list[tuple]] = {one: [], two: []}
            for r in group:
                x = np.frombuffer(r["given"], "<f8").reshape(-1, r["d"])
                ids, copies = (np.frombuffer(r[c], "<i8") for c in ("ids", "copies"))
                held[r["block"]].append((np.array(r["low"]), np.array(r["high"]), ids, copies, x, _turned(x, shared.value[r["d"]])))
            for k, a in enumerate(held[one]):
                for m, b in enumerate(held[two]):
                    apart = np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0)
                    if (one == two and m < k) or (apart * apart).sum() > far:
                        continue
                    found = linked(*[(x, y) for x, y in zip(a[2:], b[2:], strict=True)], one == two and m == k, threshold)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "n", "root"])

    return met.mapInArrow(compare, "id long, n long, root long")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, size: int = TILE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; ``vectors`` has vec_id, embedding, label.

    Vectors are compared when their labels are equal and not null and they have as many components.
    Null and zero vectors, and those with null or non-finite components, link with nothing and are kept.
    Equal vectors are compared once and link with each other. Rows that repeat a vec_id stay rows: with
    equal vectors they count as other vectors, with different ones they may have their links and their
    component in common. Rows with a null vec_id are left out. Empty tables give no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    # a vector whose squares under- or overflow has no cosine
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    usable = rows.where(good).where((square > 0) & (square < float("inf")))
    distinct = common.saved(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    axes = spark.sparkContext.broadcast({d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments(distinct).items()})
    found = common.saved(links(common.saved(tiles(distinct, axes, size, block), "tiles"), axes, threshold), "vector_links")
    common.prepare(spark)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = common.components(found, "id", "root")
    known = distinct.join(counts, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return dedup(common.read(spark, sf_dir, "embeddings"))
