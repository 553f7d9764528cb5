"""N-gram Jaccard self-join by grouped prefixes.

A document's set is its distinct word shingles. Shingles are ordered by how many documents hold them
(all those not among the most frequent count alike) and then by hash; of a set of n shingles only the
first ``n - ceil(t n) + 1`` can be the first that it shares with a set at least t alike. Documents with
the same such prefix and size are one group; groups that share a prefix shingle are filtered by size
and by how much of their prefixes they share, the rest is expanded to documents with different sets and verified
on whole texts. Shingles are compared by 64-bit hashes.

What the join is asked for is components, so long posting lists are not paired off: each group on one
is first compared with the list's most central group. Documents of a list that are then still in
different components are joined on what sets them apart from the list's center: the symmetric
differences of two sets from a third have to share more, the farther both are from it, and what they
share is rare where the shingles of the list are not. Those differences get prefixes of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, tokens

SHINGLE = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 4, 5
#: Posting lists up to this length are paired off at once.
SHORT_LIST = 64
#: Slots kept as frequent, with their counts: a fixed size.
FREQUENT_SLOTS = 1 << 16


def shingles(column: pa.Array, size: int = SHINGLE):
    """For runs of texts: (first row, shingles of each text, row and hash of each, sorted by row and hash)."""
    for first, offsets, data in common.slices(column):
        docs = len(offsets) - 1
        doc, _, _, h = common.words(offsets, data, lower=True)
        count = np.bincount(doc, minlength=docs)
        g = common.grams(h, size)
        same = doc[: len(g)] == doc[size - 1 :] if len(g) else np.zeros(0, bool)
        rows, keys = [doc[: len(g)][same]], [g[same]]
        begin = np.cumsum(count) - count
        for k in range(1, size):  # a shorter text is one shingle as a whole
            short = np.flatnonzero(count == k)
            if len(short):
                rows.append(short)
                keys.append(common.mix(_combined([h[begin[short] + j] for j in range(k)]) + np.uint64(k)))
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key = row[new], key[new]
        yield first, np.bincount(row, minlength=docs), row, key


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for j, h in enumerate(parts):
        total = common.mix(total + h * np.uint64(2 * j + 3))
    return total


def _sum_by(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, row, values)
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def count_slots(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed places of all documents' shingles."""

    def count(batches):
        tokens.forget()  # workers are kept, and so would be the words of an earlier job in them
        held, n = [], 0
        for batch in batches:
            for _, _, _, key in shingles(batch.column(0)):
                held.append(common.fine(key))
                n += len(key)
            if n > common.PACKED:
                yield common.packed_slots(np.concatenate(held), buckets)
                held, n = [], 0
        if n:
            yield common.packed_slots(np.concatenate(held), buckets)

    return docs.select("text").mapInArrow(common.released(count), common.COUNTS_SCHEMA)


SIGNED = "doc_id long, twin long, n_shingles long, vertex long, grp long, bucket int, token binary, posted binary, meta binary"


def twin():
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, buckets: int, filter_) -> DataFrame:
    """Rows of two kinds: each row's twin, set size, set hash and group, and packed prefix postings.

    A posting is a shingle with a group and (group size, share of the set that no other document has,
    in thousandths).
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def sign(batches):
        seen, slots, counts = shared.value
        tokens, groups, metas, n_held = [], [], [], 0

        def postings():
            token, group, meta = np.concatenate(tokens), np.concatenate(groups), np.concatenate(metas)
            token, group, meta = collapsed(token, group, meta)  # copies within a task count once
            bucket = ((token >> np.uint64(40)).astype(np.int64) * buckets) >> 24
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [(b, order[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b + 1] > cut[b]]
            none = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.array([b for b, _ in own], pa.int32()), *[pa.array([x[o].tobytes() for _, o in own], pa.binary()) for x in (token, group, meta)]],
                ["doc_id", "twin", "n_shingles", "vertex", "grp", "bucket", "token", "posted", "meta"],
            )

        for batch in batches:
            ids, twins = batch.column(0), batch.column(2)
            for first, size, row, key in shingles(batch.column(1)):
                n = len(size)
                where = common.slot(key)
                again = common.repeated(seen, where)
                at = np.searchsorted(slots, where)
                at[at == len(slots)] = 0
                common_ = np.where(slots[at] == where, counts[at], 0) if len(slots) else np.zeros(len(where), np.int64)
                vertex = common.mix(_sum_by(row, common.mix(key ^ np.uint64(0x5BD1E995)), n) + size.astype(np.uint64))
                order = np.lexsort((key, common_, row))
                rank = np.arange(len(row)) - (np.cumsum(size) - size)[row[order]]
                prefix = rank < (size - (NUM * size + DEN - 1) // DEN + 1)[row[order]]
                order = order[prefix]
                group = common.mix(_sum_by(row[order], common.mix(key[order] ^ np.uint64(0xC2B2AE35)), n) ^ size.astype(np.uint64))
                alone = np.bincount(row[~again], minlength=n) * 1000 // np.maximum(size, 1)
                # shingles that no other document has are in no intersection: with too many of them nothing can be alike
                keep = again[order] & (DEN * alone <= 1000 * (DEN - NUM))[row[order]]
                order = order[keep]
                r = row[order]
                tokens.append(key[order])
                groups.append(group[r])
                metas.append(np.stack([size[r], alone[r]], 1).astype("<i4"))
                n_held += len(r)
                null = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), twins.slice(first, n), pa.array(size.astype(np.int64)), pa.array(_signed(vertex)), pa.array(_signed(group)), pa.nulls(n, pa.int32()), null, null, null],
                    ["doc_id", "twin", "n_shingles", "vertex", "grp", "bucket", "token", "posted", "meta"],
                )
            if n_held > 1 << 21:
                yield postings()
                tokens, groups, metas, n_held = [], [], [], 0
        if n_held:
            yield postings()

    return docs.select(F.col("doc_id").cast("long"), "text", twin()).mapInArrow(common.released(sign), SIGNED)


def collapsed(token: np.ndarray, group: np.ndarray, meta: np.ndarray):
    """One posting of each (token, group), sorted by token and size; of several the least alone."""
    order = np.lexsort((meta[:, 1], group, meta[:, 0], token))
    token, group, meta = token[order], group[order], meta[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    return token[new], group[new], meta[new]


FOUND = "token long, x long, y long, size_x int, size_y int, alone int, n int"


def lists(posted: DataFrame, buckets: int) -> DataFrame:
    """Pairs of groups on short posting lists (token null) with the number of lists, and postings of long lists (y null)."""

    def pair(batches):
        parts = [(np.frombuffer(t.as_py(), "<u8"), np.frombuffer(g.as_py(), "<u8"), np.frombuffer(m.as_py(), "<i4").reshape(-1, 2)) for batch in batches for t, g, m in zip(*[batch.column(k) for k in ("token", "posted", "meta")], strict=True)]
        if not parts:
            return
        token, group, meta = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        token, group, meta = collapsed(token, group, meta)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.repeat(np.diff(np.r_[start, len(token)]), np.diff(np.r_[start, len(token)]))
        size = meta[:, 0].astype(np.int64)
        shared = (1000 - meta[:, 1]) * size

        short = np.flatnonzero((length >= 2) & (length <= SHORT_LIST))
        found = []
        for d in range(1, SHORT_LIST):
            a, b = short[:-d], short[d:]
            same = token[a] == token[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            ok = (DEN * size[a] >= NUM * size[b]) & ((NUM + DEN) * np.minimum(shared[a], shared[b]) >= 1000 * NUM * (size[a] + size[b]))
            a, b = a[ok], b[ok]
            swap = group[a] > group[b]
            found.append(np.stack([np.where(swap, b, a), np.where(swap, a, b)], 1))
        if found:
            found = np.concatenate(found)
            order = np.lexsort((group[found[:, 1]], group[found[:, 0]]))
            found = found[order]
            x, y = group[found[:, 0]], group[found[:, 1]]
            begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.r_[begin, len(x)])
            a, b = found[begin, 0], found[begin, 1]
            for i in range(0, len(a), 50_000):
                s = slice(i, i + 50_000)
                k = len(a[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64()), pa.array(_signed(group[a[s]])), pa.array(_signed(group[b[s]])), pa.array(size[a[s]], pa.int32()), pa.array(size[b[s]], pa.int32()), pa.nulls(k, pa.int32()), pa.array(n[s], pa.int32())],
                    FOUND_NAMES,
                )
        long = np.flatnonzero(length > SHORT_LIST)
        for i in range(0, len(long), 50_000):
            s = long[i : i + 50_000]
            none = pa.nulls(len(s), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(token[s])), pa.array(_signed(group[s])), pa.nulls(len(s), pa.int64()), pa.array(size[s], pa.int32()), none, pa.array(meta[s, 1], pa.int32()), none],
                FOUND_NAMES,
            )

    return posted.repartition(buckets, "bucket").mapInArrow(common.released(pair), FOUND)


FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (x, y of document ids) whose whole texts are alike enough."""

    def check(batches):
        for batch in batches:
            where, tokens = [], []
            sizes = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for side in range(2):
                for first, size, row, key in shingles(batch.column(2 + side)):
                    sizes[side][first : first + len(size)] = size
                    where.append(row + first)
                    tokens.append(key)
            if not where:
                continue
            row, key = np.concatenate(where), np.concatenate(tokens)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (key[1:] == key[:-1])], minlength=batch.num_rows)
            alike = (DEN * both >= NUM * (sizes[0] + sizes[1] - both)) & (both > 0)
            yield batch.select([0, 1]).filter(pa.array(alike))

    texts = with_texts(pairs, docs)
    common.prepare(pairs.sparkSession)
    return texts.mapInArrow(common.released(check), "x long, y long")


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (x, y of document ids) with text_x and text_y."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    # one of the texts where a doc_id has several: pairs are of set representatives
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(needed, "id", "left_semi")
    texts = common.saved(texts, "texts")
    left = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("text_x")), "x")
    both = left.join(texts.select(F.col("id").alias("y"), F.col("text").alias("text_y")), "y")
    return both.select("x", "y", "text_x", "text_y")


def differences(family: DataFrame, docs: DataFrame) -> DataFrame:
    """(center, id, size, center_size, apart, tokens): the shingles that only one of a document and its center has."""

    def compare(batches):
        for batch in batches:
            where, tokens = [], []
            sizes = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for side in range(2):
                for first, size, row, key in shingles(batch.column(2 + side)):
                    sizes[side][first : first + len(size)] = size
                    where.append(row + first)
                    tokens.append(key)
            row, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, tokens))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            same = np.zeros(len(row) + 1, bool)
            same[1:-1] = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
            only = ~(same[1:] | same[:-1])
            apart = np.bincount(row[only], minlength=batch.num_rows)
            lists_ = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(apart)], pa.int32()), pa.array(key[only].astype(np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (sizes[1], sizes[0], apart)], lists_], ["center", "id", "size", "center_size", "apart", "tokens"])

    spark = family.sparkSession
    texts = with_texts(family.select(F.col("center").alias("x"), F.col("id").alias("y")), docs)
    common.prepare(spark)
    return texts.mapInArrow(common.released(compare), "center long, id long, size long, center_size long, apart long, tokens array<long>")


def alike(apart: str, a: str, b: str):
    """Whether sets of sizes a and b that are so far apart are similar enough."""
    return (NUM + DEN) * F.col(apart) <= (DEN - NUM) * (F.col(a) + F.col(b))


def far_apart(deltas: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components and one center that may be alike, at least one of them not alike with the center.

    Two sets of sizes a and b are alike if they are at most r (a + b) apart, r = (DEN - NUM) / (DEN + NUM). If they are
    s and t away from a center of size c, that asks for at least (s + t - r (a + b)) / 2 common differences. One that is
    not alike with the center has t > r (b + c), so its partner's share is more than (s + r (c - a)) / 2: one of its rarest
    s - share + 1 differences is a common one. Differences that no other document of the center has are never common.
    """
    whole, gap = NUM + DEN, DEN - NUM
    each = deltas.select("center", "id", F.explode("tokens").alias("token"))
    often = each.groupBy("center", "token").agg(F.count("*").alias("n")).where("n > 1")
    rare = each.join(often, ["center", "token"]).groupBy("center", "id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    d = deltas.drop("tokens").join(rare, ["center", "id"])
    d = d.withColumn("alike", alike("apart", "size", "center_size"))
    share = F.ceil((whole * F.col("apart") + gap * (F.col("center_size") - F.col("size"))) / (2 * whole))
    d = d.withColumn("leading", F.size("tokens") - share + 1).where("NOT alike OR leading > 0")
    posts = d.select("center", "id", "component", "size", "apart", "alike", "leading", F.posexplode("tokens").alias("place", "t"))
    posts = posts.withColumn("token", F.col("t.token")).withColumn("lead", F.col("place") < F.col("leading")).drop("t", "place", "leading")
    p, q = posts.where("lead").alias("p"), posts.where("NOT alike").alias("q")
    ends = (F.col("p.component") != F.col("q.component")) & (F.col("p.alike") | (F.col("q.lead") & (F.col("p.id") < F.col("q.id"))))
    a, b = F.col("p.size"), F.col("q.size")
    fits = (DEN * F.least(a, b) >= NUM * F.greatest(a, b)) & (whole * F.abs(F.col("p.apart") - F.col("q.apart")) <= gap * (a + b))
    return p.join(q, ["center", "token"]).where(ends & fits).select(F.col("p.id").alias("x"), F.col("q.id").alias("y")).distinct()


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, twin, text_component) of every row.

    Null and white texts have no shingles and are components of their own. Equal sets are linked.
    Rows that share a doc_id and have shingles stay rows of their own and count as linked in component_id; text_component
    goes by links of texts alone, so that it tells what a row repeats itself, and twin which of these rows it is. Rows with a null doc_id are
    left out. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    common.prepare(spark)
    buckets = common.partitions(spark)
    ranges = common.slot_buckets(spark)
    filter_ = common.slot_counts(count_slots(docs, ranges), ranges, FREQUENT_SLOTS)
    common.swept(spark)  # the counts, which are most of what is shuffled
    signed = common.saved(signatures(docs, buckets, filter_), "signatures")
    del filter_  # tens of MB of the driver's
    sets = signed.where("bucket is null").select("doc_id", "twin", "n_shingles", "vertex", "grp")
    found = common.saved(lists(signed.where("bucket is not null").select("bucket", "token", "posted", "meta"), buckets), "lists")

    # documents with different sets: the smallest id of each set stands for it
    members = common.saved(sets.where("n_shingles > 0").groupBy("vertex").agg(F.min("doc_id").alias("id"), F.min_by("grp", "doc_id").alias("grp"), F.first("n_shingles").alias("size")), "members")
    long = found.where("token is not null").select("token", F.col("x").alias("grp"), F.col("size_x").alias("size"), "alone")
    heads = members.groupBy("grp").agg(F.min("id").alias("id"), F.count("*").alias("n"))

    # short lists: filter group pairs by how much of their prefixes they share, then expand
    on_long = long.groupBy("grp").agg(F.count("*").alias("n_long"))
    pairs = found.where("token is null").groupBy("x", "y", "size_x", "size_y").agg(F.sum("n").alias("n"))
    pairs = pairs.join(on_long.select(F.col("grp").alias("x"), F.col("n_long").alias("long_x")), "x", "left")
    pairs = pairs.join(on_long.select(F.col("grp").alias("y"), F.col("n_long").alias("long_y")), "y", "left")
    pairs = common.saved(pairs, "pairs")
    a, b = F.col("size_x").cast("long"), F.col("size_y").cast("long")
    # what lies behind the prefixes can add no more than this
    behind = F.greatest(a - _prefix(a), b - _prefix(b))
    possible = F.col("n") + F.least(F.coalesce("long_x", F.lit(0)), F.coalesce("long_y", F.lit(0))) + behind
    close = pairs.where(possible >= _least(a, b))
    side = lambda c: members.select(F.col("grp").alias(c), F.col("id").alias(f"id_{c}"))
    expanded = close.join(side("x"), "x").join(side("y"), "y").select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))

    # long lists: each group against the most central one that it meets most often
    central = long.groupBy("token").agg(F.min(F.struct("alone", "grp", "size")).alias("c"))
    may = lambda one, other: (DEN * F.least(f"{one}size", f"{other}size") >= NUM * F.greatest(f"{one}size", f"{other}size")) & (
        # an intersection has no shingle that only one document holds
        (NUM + DEN) * F.least((1000 - F.col(f"{one}alone")) * F.col(f"{one}size").cast("long"), (1000 - F.col(f"{other}alone")) * F.col(f"{other}size").cast("long")) >= 1000 * NUM * (F.col(f"{one}size").cast("long") + F.col(f"{other}size").cast("long"))
    )
    star = long.join(central, "token").where((F.col("grp") != F.col("c.grp")) & may("", "c."))
    star = star.groupBy("grp", F.col("c.grp").alias("center")).agg(F.count("*").alias("n"))
    star = star.groupBy("grp").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
    one = heads.select("grp", "id")
    star = star.join(one.withColumnRenamed("id", "x"), "grp").join(one.select(F.col("grp").alias("center"), F.col("id").alias("y")), "center").select("x", "y")
    # within a group: each document against the first one
    inside = members.join(heads.where("n > 1").select("grp", F.col("id").alias("y")), "grp").where("id != y").select(F.col("id").alias("x"), "y")

    tidy = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    first = common.saved(tidy(expanded.union(star).union(inside)), "first")
    links = common.saved(verified(first, docs), "links")

    # what is left of long lists and groups: documents of different components, each with the list's center
    labels = common.components(links, "x", "y")
    known = members.join(labels, members.id == labels.node, "left").select("id", "grp", F.col("size").cast("long").alias("size"), F.coalesce("component", "id").alias("component"))
    known = common.saved(known, "known")
    mixed = lambda d, key: d.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select(key)
    split = known.join(mixed(known, "grp"), "grp", "left_semi").join(heads.select("grp", F.col("id").alias("center")), "grp")
    posts = long.select("token", "grp").join(known, "grp")
    posts = posts.join(mixed(posts, "token"), "token", "left_semi")
    centers = central.select("token", F.col("c.grp").alias("grp")).join(one.withColumnRenamed("id", "center"), "grp").drop("grp")
    family = split.select("center", "id").union(posts.join(centers, "token").select("center", "id")).where("center != id").distinct()
    family = common.saved(family, "families")
    if not family.isEmpty():
        deltas = common.saved(differences(family, docs).join(known.select("id", "component"), "id"), "deltas")
        near = deltas.where(alike("apart", "size", "center_size")).select(F.col("id").alias("x"), F.col("center").alias("y"))
        second = common.saved(tidy(far_apart(deltas)).join(first, ["x", "y"], "left_anti"), "second")
        links = links.union(tidy(near)).union(common.saved(verified(second, docs), "more_links"))
        labels = common.components(links, "x", "y")

    common.swept(spark)  # the caller may shuffle its texts
    in_set = lambda found, name: members.select("vertex", "id").join(found, members.id == found.node, "left").select("vertex", F.coalesce("component", "id").alias(name))
    joined = sets.join(in_set(labels, "of_text"), "vertex", "left")
    of_text = F.when(F.col("n_shingles") > 0, F.col("of_text")).otherwise(F.col("doc_id"))
    # a doc_id with several sets links them
    several = sets.where("n_shingles > 0").groupBy("doc_id").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low != high").select("doc_id")
    several = common.saved(several, "several")
    if several.isEmpty():
        return joined.select("doc_id", "n_shingles", of_text.alias("component_id"), "twin", of_text.alias("text_component"))
    own = sets.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "vertex").distinct().join(members.select("vertex", "id"), "vertex")
    labels = common.components(links.union(own.select(F.col("doc_id").alias("x"), F.col("id").alias("y"))), "x", "y")
    joined = joined.join(in_set(labels, "of_doc"), "vertex", "left")
    of_doc = F.when(F.col("n_shingles") > 0, F.col("of_doc")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", of_doc.alias("component_id"), "twin", of_text.alias("text_component"))


def _least(a, b):
    """The smallest intersection of sets of sizes a and b that are alike enough."""
    return F.floor((NUM * (a + b) + NUM + DEN - 1) / (NUM + DEN))


def _prefix(n):
    """Shingles of a set of n that have to be looked up."""
    return n - F.ceil(NUM * n / DEN) + 1


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id."""
    return cluster(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
