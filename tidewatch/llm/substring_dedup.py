"""Exact substring dedup: FM-indexes of shards, searched backward through wavelet matrices.

A window is WINDOW consecutive words. Shards are cut by content, so that equal windows meet in one:
the windows that follow each other at the same minimizer (the place of the least hash of their runs of SEED words)
make a fragment, and a fragment goes to the shard of its minimizer. Fragments whose minimizer occurs
once cannot repeat anything and stay where they are. Each shard builds a compressed index of its
distinct fragments and streams them through it: backward search gives, for each position, the interval
of suffixes that match from there on; its class among the suffixes cut at WINDOW words tells where the
same window starts first. Minimizers are compared by 64-bit hashes and words by 48 bits of theirs: for two
windows to be taken for one, each of their 20 words has to be equal or to collide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

WINDOW = 20
SEED = 8
#: A minimizer that occurs oftener is hot: its windows are dealt out one by one, by their own hash.
HOT = 1024
#: Most hot minimizers that are told to the executors: a fixed size. Others go to shards as a whole.
HOT_SLOTS = 1 << 16
#: Words of fragments that a task holds before it sends them off.
HELD_WORDS = 1 << 21
#: Bytes of text for which there is a shard, so that none grows with the input, and shards in a partition beyond
#: the session's number of partitions. A task holds one shard at a time.
SHARD_BYTES, SHARDS = 4 << 20, 32
#: Bytes of a word's hash that are sent.
WORD_BYTES = 6
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


# ------------------------------------------------------------------ fragments


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def fragments(column: pa.Array):
    """For runs of texts: (first row, word hashes, fragments as row, start in the text, start in the hashes, words, minimizer hash)."""
    for first, offsets, data in common.slices(column):
        doc, _, _, h = common.words(offsets, data)
        if len(h) < WINDOW:
            continue
        seeds = common.grams(h, SEED)
        place = np.uint64((1 << len(seeds).bit_length()) - 1)
        # the first one of the least: a run that repeats within a fragment must not hide in it
        low = _least_in_window((seeds & ~place) | np.arange(len(seeds), dtype=np.uint64), WINDOW - SEED + 1) & place
        at = np.flatnonzero(doc[: len(low)] == doc[WINDOW - 1 :])
        if len(at) == 0:
            continue
        low, row = low[at], doc[at]
        new = np.r_[True, low[1:] != low[:-1]]
        begin = np.flatnonzero(new)
        n = np.diff(np.r_[begin, len(at)])
        count = np.bincount(doc, minlength=len(offsets) - 1)
        doc_start = np.cumsum(count) - count
        yield first, h, row[begin], at[begin] - doc_start[row[begin]], at[begin], n + WINDOW - 1, common.mix(seeds[low[begin].astype(np.int64)] ^ np.uint64(0xA0761D6478BD642F))


def count_slots(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed places of the minimizers of all fragments."""

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for *_, key in fragments(batch.column(0)):
                held.append(common.fine(key))
                n += len(key)
            if n > common.PACKED:
                yield common.packed_slots(np.concatenate(held), buckets)
                held, n = [], 0
        if n:
            yield common.packed_slots(np.concatenate(held), buckets)

    return docs.select("text").mapInArrow(common.released(count), common.COUNTS_SCHEMA)


PIECES = "bucket int, doc binary, twin binary, start binary, size binary, words binary"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    ends = np.cumsum(sizes)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)


def _content(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the concatenated runs of words."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - np.repeat(begin, sizes)
    return common.mix(np.add.reduceat(common.mix(words + common.mix(place.astype(np.uint64) + np.uint64(1))), begin) + sizes.astype(np.uint64))


class Held:
    """Fragments that a task or a shard holds, put together as arrays; a document is a doc_id and the hash of its text."""

    def __init__(self, parts):
        self.doc, self.twin, self.start, self.size, self.key = (np.concatenate([p[i] for p in parts]) for i in range(5))
        self.words = np.concatenate([p[5] for p in parts])

    def pick(self, which: np.ndarray) -> None:
        """Keep these of the fragments, words aside."""
        self.doc, self.twin, self.start, self.size, self.key = (x[which] for x in (self.doc, self.twin, self.start, self.size, self.key))

    def distinct(self):
        """Order the fragments by place and keep the first of those with equal words; returns what the others cover."""
        order = np.lexsort((self.start, self.twin, self.doc))
        words = self.words[_ranges((np.cumsum(self.size) - self.size)[order], self.size[order])]
        self.pick(order)
        content = _content(words, self.size)
        _, first, which = np.unique(content, return_index=True, return_inverse=True)
        keep = np.zeros(len(order), bool)
        keep[first] = True
        same = (self.doc == self.doc[first[which]]) & (self.twin == self.twin[first[which]]) & (self.start == self.start[first[which]])
        gone = ~keep & ~same
        removed = self.doc[gone], self.twin[gone], self.start[gone], self.start[gone] + self.size[gone]
        self.words = words[np.repeat(keep, self.size)]
        self.pick(keep)
        return removed

    def rows(self, buckets: int):
        """The fragments as packed rows, one for each bucket."""
        bucket = ((self.key >> np.uint64(40)).astype(np.int64) * buckets) >> 24
        order = np.argsort(bucket, kind="stable")
        begin = np.cumsum(self.size) - self.size
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                words = self.words[_ranges(begin[own], self.size[own])]
                out.append((b, self.doc[own].tobytes(), self.twin[own].tobytes(), self.start[own].tobytes(), self.size[own].astype("<i4").tobytes(), _sent(words)))
        return _packed(out)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _NAMES)


def _sent(words: np.ndarray) -> bytes:
    """The lower WORD_BYTES of each hash."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def _received(words: bytes) -> np.ndarray:
    out = np.zeros((len(words) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(words, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel()


def _twin():
    """What tells rows of one doc_id apart."""
    return F.xxhash64("text")


def cut(docs: DataFrame, buckets: int, filter_) -> DataFrame:
    """Packed fragments for the shards, and (without words) intervals already known to be repeated within a task."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def send(batches):
        seen, slots, counts = shared.value
        hot = slots[counts > HOT]
        parts, n = [], 0

        def off():
            held = Held(parts)
            removed = held.distinct()
            if len(removed[0]):
                doc, twin, start, end = removed
                yield _packed([(int(doc[0]) % buckets, doc.tobytes(), twin.tobytes(), start.tobytes(), (end - start).astype("<i4").tobytes(), None)])
            yield held.rows(buckets)

        for batch in batches:
            ids, twins = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for first, h, row, start, at, size, key in fragments(batch.column(1)):
                where = common.slot(key)
                keep = common.repeated(seen, where)
                is_hot = keep & np.isin(where, hot)
                own = keep & ~is_hot
                if own.any():
                    mine = row[own] + first
                    parts.append((ids[mine], twins[mine], start[own], size[own], key[own], h[_ranges(at[own], size[own])]))
                    n += len(parts[-1][5])
                if is_hot.any():
                    windows = size[is_hot] - WINDOW + 1
                    at_ = _ranges(at[is_hot], windows)
                    words = h[_ranges(at_, np.full(len(at_), WINDOW))]
                    size_ = np.full(len(at_), WINDOW)
                    mine = np.repeat(row[is_hot] + first, windows)
                    parts.append((ids[mine], twins[mine], _ranges(start[is_hot], windows), size_, _content(words, size_), words))
                    n += len(words)
            if n > HELD_WORDS:
                yield from off()
                parts, n = [], 0
        if parts:
            yield from off()

    return docs.select(F.col("doc_id").cast("long"), "text", _twin()).where("doc_id is not null").mapInArrow(common.released(send), PIECES)


# ------------------------------------------------------------------- the index


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of a symbol, with counts for each 64 bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n, self.levels = len(values), max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            packed = np.zeros((self.n >> 6) + 1, "<u8")
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.bitwise_count(packed).astype(np.int32)
            self.bits.append(packed)
            self.counts.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(symbols)
        self.base = np.zeros(symbols, np.int64)
        self.base = self.rank(every, np.zeros(symbols, np.int64))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of each symbol there are before each end."""
        at = end
        for i in range(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][block] + np.bitwise_count(self.bits[i][block] & mask)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at - self.base[symbol]


class FMIndex:
    """A compressed index of sequences of symbols from 1 on; 0 ends each sequence."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, symbols: int):
        n = len(text)
        end_of = np.repeat(ends, np.diff(np.r_[-1, ends]))
        place = np.arange(n)
        rank, length, longest = text.astype(np.int64), 1, int((end_of - place).max()) + 1

        def paired(rank, by):
            """Ranks by what two ranks, one ``by`` places on, say together."""
            ahead = place + by
            second = np.where(ahead <= end_of, rank[np.minimum(ahead, n - 1)], -1) + 1
            pair = rank * (int(rank.max()) + 2) + second
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            out = np.empty(n, np.int64)
            out[order] = new
            return out, order

        while length * 2 <= WINDOW:
            rank, order = paired(rank, length)
            length *= 2
        # suffixes cut at WINDOW words, then whole ones
        cut_, _ = paired(rank, WINDOW - length)
        while length < longest:
            rank, order = paired(rank, length)
            length *= 2
        self.suffixes = order
        before = np.where(order > 0, text[order - 1], 0)
        before[np.isin(order, np.r_[0, ends[:-1] + 1])] = 0
        self.wavelet = WaveletMatrix(before, symbols)
        self.first = np.cumsum(np.bincount(text, minlength=symbols)) - np.bincount(text, minlength=symbols)
        self.n = n
        in_order = cut_[order]
        starts = np.r_[True, in_order[1:] != in_order[:-1]]
        self.class_of = np.cumsum(starts) - 1
        self.earliest = np.minimum.reduceat(order, np.flatnonzero(starts))

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of suffixes that start with the symbols and go on as those in [low, high)."""
        k = len(symbol)
        both = self.first[np.r_[symbol, symbol]] + self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        return both[:k], both[k:]


def matches(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of the concatenated fragments (in order of place): where it starts, and where an equal one starts first.

    Places count in ``words``. All fragments are searched in step, from their last words on.
    """
    _, local = np.unique(words, return_inverse=True)
    symbols = int(local.max()) + 2
    starts = np.cumsum(sizes) - sizes
    begin = starts + np.arange(len(sizes))
    text = np.zeros(len(words) + len(sizes), np.int64)
    at = _ranges(begin, sizes)
    text[at] = local + 1
    ends = begin + sizes
    index = FMIndex(text, ends, symbols)
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.n, np.int64)
    where, first = [], []
    live = np.arange(len(sizes))
    for back in range(1, int(sizes.max()) + 1):
        live = live[sizes[live] >= back]
        place = ends[live] - back
        low[live], high[live] = index.backward(text[place], low[live], high[live])
        if back >= WINDOW:
            where.append(place)
            first.append(index.earliest[index.class_of[low[live]]])
    place, early = np.concatenate(where), np.concatenate(first)
    number = np.searchsorted(begin, np.stack([place, early]), "right") - 1
    return place - number[0], early - number[1]


INTERVALS = "doc_id long, twin long, start long, end long"


def search(pieces: DataFrame, partitions: int) -> DataFrame:
    """INTERVALS: words that windows cover which start earlier elsewhere. They may overlap."""

    def rows(*columns):
        for i in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000], pa.int64()) for x in columns], ["doc_id", "twin", "start", "end"])

    def shard(parts):
        held = Held(parts)
        parts.clear()
        yield from rows(*held.distinct())
        begin = np.cumsum(held.size) - held.size
        where, first = matches(held.words, held.size)
        own, other = np.searchsorted(begin, where, "right") - 1, np.searchsorted(begin, first, "right") - 1
        a, b = held.start[own] + where - begin[own], held.start[other] + first - begin[other]
        later = (held.doc[own] != held.doc[other]) | (held.twin[own] != held.twin[other]) | (a != b)
        own, a = own[later], a[later]
        doc, twin = held.doc[own], held.twin[own]
        order = np.lexsort((a, twin, doc))
        doc, twin, a = doc[order], twin[order], a[order]
        if len(a):
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (a[1:] != a[:-1] + 1)])
            last = np.r_[new[1:], len(a)] - 1
            yield from rows(doc[new], twin[new], a[new], a[last] + WINDOW)

    def find(batches):
        parts, held = [], None
        for batch in batches:
            columns = [batch.column(k) for k in _NAMES]
            for bucket, doc, twin, start, size, words in zip(*columns, strict=True):
                bucket = bucket.as_py()
                if parts and bucket != held:
                    yield from shard(parts)
                held = bucket
                doc, twin, start = (np.frombuffer(x.as_py(), "<i8") for x in (doc, twin, start))
                size = np.frombuffer(size.as_py(), "<i4").astype(np.int64)
                if words.is_valid:
                    parts.append((doc, twin, start, size, np.zeros(len(size), np.uint64), _received(words.as_py())))
                else:
                    yield from rows(doc, twin, start, start + size)
        if parts:
            yield from shard(parts)

    # shards come one behind another, so a task works through them
    return pieces.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(common.released(find), INTERVALS)


def without(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """A text less the words in ascending intervals, its number of words, and how many went.

    A run of words goes with the white space behind it; the rest stays as it is.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    edge = [a for a, _ in spans] + [len(text)]
    kept, last, n = [], 0, 0
    for a, b in gone:
        a, b = max(a, last), min(b, len(spans))
        if a < b:
            kept.append(text[edge[last] if last else 0 : edge[a]])
            n += b - a
            last = b
    kept.append(text[edge[last] if last else 0 :])
    return b"".join(kept), len(spans), n


def remove(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less the words in the intervals, n_words and n_removed; other texts stay as they are."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    key, twin, gone_ = (common.unused(c, names) for c in ("key", "twin", "gone"))
    held = intervals.groupBy(F.col("doc_id").alias(key), F.col("twin").alias(twin)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone_))
    left = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = left.join(held, (F.col("doc_id").cast("long") == F.col(key)) & (_twin() == F.col(twin)), "left").drop(key, twin)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", n_words long, n_removed long"
    common.prepare(spark)

    def drop(batches):
        place = names.index("text")
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, gone in zip(batch.column(place).cast(pa.large_binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if gone:
                    text, n, less = without(text or b"", [(x["start"], x["end"]) for x in gone])
                else:
                    n, less = len((text or b"").split()), 0
                texts.append(text)
                n_words.append(n)
                n_removed.append(less)
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_words", "n_removed"])

    return joined.mapInArrow(common.released(drop), schema)


def shards(docs: DataFrame) -> int:
    """The number of shards for the documents."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(common.partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with every word removed that a window covers which starts earlier, by (doc_id, place).

    Adds n_words (of the whole text) and n_removed; a column of these names in ``docs`` is replaced.
    Texts of which nothing is removed stay as they are, null and empty ones included. Rows with a null doc_id
    have no place in the order: they stay whole and cover nothing. Rows of one doc_id with different texts are documents of their own,
    in the order of a hash of the text; equal rows are one document, so they take nothing from each other. Empty tables give no
    rows; other columns are kept.
    """
    common.prepare(docs.sparkSession)
    buckets, wide = shards(docs), common.partitions(docs.sparkSession)
    ranges = common.slot_buckets(docs.sparkSession)
    filter_ = common.slot_counts(count_slots(docs, ranges), ranges, HOT_SLOTS)
    common.swept(docs.sparkSession)  # the counts
    return remove(docs, search(cut(docs, buckets, filter_), max(wide, buckets // SHARDS)))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_words, n_removed, kept_sha256."""
    docs = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), " ")
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
