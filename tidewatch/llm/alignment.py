"""Two tokenizers' ids of the same texts aligned at the bytes where tokens of both end.

Tokenizer A is byte-level BPE, B a SentencePiece model; both encode a blank and the text. The tokens of a run of
documents are laid out on one line of bytes, document behind document. The ends of A's and of B's tokens are counted
by byte (``np.bincount``); the line is cut where both have one, which it always is between documents. Groups and links of
single documents come from prefix sums, read off at the documents' borders.

A link is a pair of an A and a B token that end together. How often each pair of ids is linked in all documents is counted
by Spark. Of two tokens that end together the shorter one's bytes end the longer one's, so there are at most as many different
pairs as both vocabularies' tokens have bytes, some hundred thousand, whatever the corpus holds: that table may be gathered and broadcast.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, prefix_bpe, sentencepiece_codec, tokens

#: Stretches whose ids a Python worker remembers; beyond it the memory is emptied and filled anew.
STRETCHES = 500_000
#: Characters of cuts that B's codec remembers.
CUT_CHARS = 16 << 20
_LOADED: dict[tuple[str, str], Both] = {}

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


class Both:
    """Both tokenizers, and what they make of stretches of text that both cut at."""

    def __init__(self, path_a: str, path_b: str):
        self.a = prefix_bpe.Encoder(path_a, special=False)
        self.b = sentencepiece_codec.Codec(path_b, 0.0, 0)
        #: what tokens spell; a control token spells nothing
        self.spelt = self.a.merges.bytes, self.b.spelt
        self.size = tuple(np.array([len(x) for x in spelt], np.int64) for spelt in self.spelt)
        self.n_b = len(self.b.spelt)
        self.chars = 0
        #: how ids are written: A's inside and at the end of its group, then B's
        self.written = [f"{i}{mark}" for spelt, marks in zip(self.spelt, (",|", ",;"), strict=True) for i in range(len(spelt)) for mark in marks]
        self.forget()

    def forget(self) -> None:
        """Start with an empty memory."""
        self.known: dict[str, int] = {}
        self.ids = sentencepiece_codec.Pool(np.int64), sentencepiece_codec.Pool(np.int64)

    def encode(self, texts: list[str | None]):
        """(ids of all texts, number of each text) for A and for B; texts are given with their blank."""
        if len(self.known) > STRETCHES:
            self.forget()
        parts = [self.a.parts(t) if t else [] for t in texts]
        # the long ones come last, so that they can be taken off again
        new = sorted({p for own in parts for p in own if p not in self.known}, key=len)
        short = bisect.bisect_right(new, prefix_bpe.KEPT_CHARS, key=len)
        for some in (new[:short], new[short:]):
            before = [(pool.n, pool.runs) for pool in self.ids]
            self.learn(some)
        which = np.array([self.known[p] for own in parts for p in own], np.int64)
        border = np.cumsum([0, *map(len, parts)])
        out = []
        for pool, (n, runs) in zip(self.ids, before, strict=True):
            sizes = pool.size(which)
            out.append((pool.all()[sentencepiece_codec.ranges(pool.start(which), sizes)], np.diff(np.r_[0, np.cumsum(sizes)][border])))
            pool.n, pool.runs = n, runs
        for part in new[short:]:
            del self.known[part]
        return out

    def learn(self, new: list[str]) -> None:
        """Put the ids of stretches behind those that are known."""
        if not new:
            return
        ids_a = self.a.learn(new)
        cuts = [sentencepiece_codec._CUT.findall(p) for p in new]
        known = self.b.known
        self.chars += sum(map(len, {c for own in cuts for c in own if c not in known}))
        self.b.learn([c for own in cuts for c in own])
        plain, known = self.b.plain, self.b.known
        which = np.array([known[c] for own in cuts for c in own], np.int64)
        sizes = plain.size(which)
        flat = plain.all()[sentencepiece_codec.ranges(plain.start(which), sizes)]
        edge = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, cuts)])]
        self.ids[0].add(np.frombuffer(b"".join([ids_a[p] for p in new]), "<u4").astype(np.int64), np.array([len(ids_a[p]) // 4 for p in new]))
        self.ids[1].add(flat.astype(np.int64), np.diff(edge))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        if len(known) > STRETCHES or self.chars > CUT_CHARS:
            self.b.forget()
            self.chars = 0

    def tokens(self, texts: list[str | None]):
        """As ``encode``, from texts without their blank; those that are null, empty or do not come back in bytes have no ids.

        B writes its blank mark where a text has that character itself, so such a text does not come back.
        """
        whole = [None if not t or sentencepiece_codec.SPACE in t else " " + t for t in texts]
        while True:
            found = self.encode(whole)
            want = "".join([t or "" for t in whole]).encode()
            spelled = [b"".join([spelt[i] for i in ids.tolist()]) for (ids, _), spelt in zip(found, self.spelt, strict=True)]
            if all(s == want for s in spelled):
                return found
            edges = [np.r_[0, np.cumsum(self.size[k][ids])][np.r_[0, np.cumsum(n)]].tolist() for k, (ids, n) in enumerate(found)]
            whole = [t if t and all(s[e[i] : e[i + 1]] == t.encode() for s, e in zip(spelled, edges, strict=True)) else None for i, t in enumerate(whole)]


def load(path_a: str, path_b: str) -> Both:
    """The tokenizers of a worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Both(path_a, path_b)
    return _LOADED[path_a, path_b]


def cut(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens, given by their bytes, end where a token of the other kind does; all on one line of bytes."""
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    n = int(max(end_a[-1:].sum(), end_b[-1:].sum())) + 1
    both = (np.bincount(end_a, minlength=n) > 0) & (np.bincount(end_b, minlength=n) > 0)
    return both[end_a], both[end_b]


def _per_document(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the values between borders."""
    return np.diff(np.r_[0, np.cumsum(flags)][borders])


def aligned(both: Both, texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, links) of each text; links are ``packed_links``.

    Tokens that spell nothing do not occur in texts, so that at each cut one A and one B token end and make one link.
    """
    (a, n_a), (b, n_b) = both.tokens(texts)
    last_a, last_b = cut(both.size[0][a], both.size[1][b])
    at_a, at_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    groups = _per_document(last_a, at_a)
    # groups in turn: A's ids and then B's; an id's place counts those of the other side before it
    before_a, before_b = np.r_[0, np.flatnonzero(last_a) + 1], np.r_[0, np.flatnonzero(last_b) + 1]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    line = np.zeros(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
    line[np.arange(len(b)) + before_a[group_b + 1]] = 2 * (len(both.spelt[0]) + b) + last_b
    key = a[last_a] * both.n_b + b[last_b]
    at_line, at_key = (at_a + at_b).tolist(), np.r_[0, np.cumsum(groups)].tolist()
    out = []
    for d in range(len(texts)):
        digest = ""
        if n_a[d]:
            text = "".join([both.written[i] for i in line[at_line[d] : at_line[d + 1]].tolist()])
            digest = hashlib.sha256(text[:-1].encode()).hexdigest()
        out.append((int(n_a[d]), int(n_b[d]), int(groups[d]), at_key[d + 1] - at_key[d], digest, packed_links(key[at_key[d] : at_key[d + 1]])))
    return out


def packed_links(key: np.ndarray) -> bytes:
    """A document's different pairs in ascending order, as gaps, and then how often each is linked: 4 bytes each."""
    pairs, n = np.unique(key, return_counts=True)
    return np.r_[np.diff(pairs, prepend=0), n].astype("<u4").tobytes()


def unpacked_links(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, how often each is linked)."""
    pairs, n = np.frombuffer(links, "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(pairs), n


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (doc_id, text) aligned: a written table of ALIGNED rows, a row for each.

    Null and empty texts, and texts that do not come back in bytes from both tokenizers, have no tokens: zeros and an empty digest. Repeated rows and
    rows without a doc_id are aligned one by one; an empty table gives an empty one. Other columns are left out.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def run(batches):
        both = load(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, offsets, _ in common.slices(texts):
                n = len(offsets) - 1
                rows = aligned(both, texts.slice(first, n).to_pylist())
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [c.split()[0] for c in ALIGNED.split(", ")])

    path = common.new_dir(spark, "aligned")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.released(run), ALIGNED)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ALIGNED).parquet(path)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents of an ``align``-ed table join each pair of ids; a task sums up its own first."""

    def count(batches):
        held = [np.zeros((2, 0), np.int64)]
        for batch in batches:
            held += [np.stack(unpacked_links(links.as_py())) for links in batch.column(0)]
            pairs, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, back, np.concatenate([h[1] for h in held]))
            held = [np.stack([pairs, total])]
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])

    return table.select("links").mapInArrow(common.released(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def rated(table: DataFrame, n_b: int) -> DataFrame:
    """An ``align``-ed table with n_best and count_sum instead of links.

    n_best counts links whose pair is linked oftenest among all pairs with its B id, ties included; count_sum adds up the links' counts.
    """
    common.prepare(table.sparkSession)
    counts = pair_counts(table).toArrow().sort_by("pair")  # as many rows as both vocabularies allow, whatever the corpus
    pairs, n = (counts.column(c).combine_chunks().to_numpy() for c in ("pair", "n"))
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, pairs % n_b, n)
    shared = table.sparkSession.sparkContext.broadcast((pairs, n, n == most[pairs % n_b]))

    def rate(batches):
        pairs, n, best = shared.value
        for batch in batches:
            links = [unpacked_links(x.as_py()) for x in batch.column(batch.schema.get_field_index("links"))]
            at = np.searchsorted(pairs, np.concatenate([np.zeros(0, np.int64), *[k for k, _ in links]]))
            times = np.concatenate([np.zeros(0, np.int64), *[t for _, t in links]])
            borders = np.cumsum([0, *[len(k) for k, _ in links]])
            new = [_per_document(times * best[at], borders), _per_document(times * n[at], borders)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, new)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    kept = [c for c in ALIGNED.split(", ") if c.split()[0] != "links"]
    return table.select(*[c.split()[0] for c in kept], "links").mapInArrow(common.released(rate), ", ".join([*kept, "n_best long", "count_sum long"]))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between both tokenizers: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    path_a, path_b = tokens.vocabulary_path(), sentencepiece_codec.model_path()
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = align(common.read(spark, sf_dir, "documents"), path_a, path_b)
    return rated(table, n_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
