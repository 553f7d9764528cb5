"""SentencePiece (merge-type) encoding with seeded merge dropout, and decoding.

Candidate merges wait on an agenda by score; each one that comes up is skipped where a keyed hash of
its place and piece falls below the dropout rate. Segmentations vary with the key, but always spell
the text. Pieces hold white space only in front, and no line feed, so the text is cut there and each
cut is encoded on its own. The key of a cut is made of the seed, the document and the cut's number, so
every occurrence draws anew. What is remembered of a cut is what no key changes: its merges without
dropout. An occurrence whose key skips none of them has those ids; the agendas of all others are worked
off together, a merge of each at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, tokens

DROPOUT, SEED = 0.1, 17
SPACE = "▁"
#: Stands for a text's own U+2581 while a cut is merged: a character that no text has.
FOREIGN = "\udc81"
_WORD = (1 << 64) - 1
_CUT = re.compile(" *[^ \n]+| +|\n")
#: Cuts that a Python worker remembers, and the longest that share an agenda; longer ones have one of their own.
REMEMBERED, LONGEST = 1_000_000, 40
#: Cuts that are encoded in one numpy pass; a text of more is a pass of its own.
PASS_CUTS = 1 << 17
#: Cuts that share an agenda.
ROWS = 1 << 14
#: Rank of what is no merge.
_NONE = np.int32(2**31 - 1)
_LOADED: dict[tuple, "Codec"] = {}


def model_path() -> str:
    """Where the merge-type model is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Pool:
    """Runs of values, one behind another in an array that grows."""

    def __init__(self, kind):
        self.values, self.ends, self.n, self.runs = np.zeros(1024, kind), np.zeros(1024, np.int64), 0, 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Put runs of these sizes behind the others."""
        self.values, self.ends = _room(self.values, self.n + len(values)), _room(self.ends, self.runs + len(sizes) + 1)
        self.values[self.n : self.n + len(values)] = values
        self.ends[self.runs + 1 : self.runs + 1 + len(sizes)] = self.n + np.cumsum(sizes)
        self.n, self.runs = self.n + len(values), self.runs + len(sizes)

    def start(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which]

    def size(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which + 1] - self.ends[which]

    def all(self) -> np.ndarray:
        return self.values[: self.n]


def _room(values: np.ndarray, n: int) -> np.ndarray:
    if n <= len(values):
        return values
    wider = np.zeros(max(n, 2 * len(values)), values.dtype)
    wider[: len(values)] = values
    return wider


class Agenda:
    """Works off the merges of many cuts at once, of each cut its best one at a time."""

    def __init__(self, ids: dict[str, int], merges: dict[str, float]):
        # symbols are ids of pieces; a character that is no piece is ``pieces`` + its code point
        self.pieces = max(ids.values(), default=0) + 1
        self.letters = np.arange(0x110000, dtype=np.int64) + self.pieces
        for piece, i in ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        self.letters[ord(" ")] = self.letters[ord(SPACE)]
        self.letters[ord(SPACE)] = self.pieces + ord(SPACE)
        blank = self.letters[ord(" ")]
        rank = {score: n for n, score in enumerate(sorted({*merges.values()}))}
        self.rank = np.full(self.pieces, _NONE)
        key, value = [], []
        for piece, i in ids.items():
            self.rank[i] = rank[merges[piece]]
            for k in range(1, len(piece)):
                ends = []
                for part in (piece[:k], piece[k:]):
                    found = ids.get(part)
                    if found is None and len(part) == 1:
                        found = int(blank if part == SPACE else self.letters[ord(part)])
                    ends.append(found)
                if None not in ends:
                    key.append(ends[0] << 32 | ends[1])
                    value.append(i)
        key, value = np.array(key, np.uint64), np.array(value, np.int32)
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.slots, self.found = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # the first that comes to a free slot has it, others go on
            free = self.found[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.slots[at[placed]], self.found[at[placed]] = key[placed], value[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.slots[at] == key, self.found[at], -1)
        go = np.flatnonzero((out < 0) & (self.found[at] >= 0))
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            out[go] = np.where(self.slots[at[go]] == key[go], self.found[at[go]], -1)
            go = go[(out[go] < 0) & (self.found[at[go]] >= 0)]
        return out

    def work(self, cuts: list[str], sizes: np.ndarray, skipped):
        """(symbols that are left, one cut behind another, number of each cut, [(row, place and piece) of merges]).

        ``skipped`` tells of rows and their merges which ones the key skips; None skips none and lists the merges.
        """
        rows, wide = len(cuts), int(sizes.max())
        inside = np.arange(wide) < sizes[:, None]
        symbol = np.full((rows, wide), -1, np.int64)
        symbol[inside] = self.letters[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        place = np.arange(rows)
        after = np.tile(np.arange(1, wide + 1, dtype=np.int16), (rows, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int16), (rows, 1))
        piece, rank = np.full((rows, wide), -1, np.int32), np.full((rows, wide), _NONE)

        def put(row, at, left, right):
            """What each pair of symbols makes goes on its row's agenda."""
            made = self.merged(left, right)
            fine = made >= 0
            if skipped is not None:
                on = np.flatnonzero(fine)
                fine[on] = ~skipped(place[row[on]], (at[on].astype(np.int64) << 16 ^ made[on]).astype(np.uint64))
            piece[row, at] = made
            rank[row, at] = np.where(fine, self.rank[made], _NONE)

        pairs = inside[:, 1:]
        row, at = np.nonzero(pairs)
        put(row, at, symbol[:, :-1][pairs], symbol[:, 1:][pairs])
        done, out = [], np.full((rows, wide), -1, np.int64)
        while True:
            j = rank.argmin(1)
            live = rank[np.arange(len(j)), j] != _NONE
            if not live.all():
                out[place[~live]] = symbol[~live]
                if not live.any():
                    break
                symbol, after, before, piece, rank, place, j = (x[live] for x in (symbol, after, before, piece, rank, place, j))
            row = np.arange(len(j))
            made, k = piece[row, j].astype(np.int64), after[row, j].astype(np.int64)
            if skipped is None:
                done.append((place, j << 16 ^ made))
            symbol[row, j], symbol[row, k], rank[row, k] = made, -1, _NONE
            far = after[row, k].astype(np.int64)
            after[row, j] = far
            right = np.flatnonzero(far < sizes[place])
            before[right, far[right]] = j[right]
            rank[row, j] = _NONE
            back = before[row, j].astype(np.int64)
            left = np.flatnonzero(back >= 0)
            put(np.r_[right, left], np.r_[j[right], back[left]], np.r_[made[right], symbol[left, back[left]]], np.r_[symbol[right, far[right]], made[left]])
        kept = out >= 0
        return out[kept], kept.sum(1), done


class Codec:
    """A model's pieces with a dropout rate and a seed."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed = int(dropout * 2**32), seed
        self.merges: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.spelt: list[bytes] = []
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.spelt.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.spelt.append(b"")
            else:
                self.ids[piece], self.merges[piece] = i, -sp.get_score(i)
                self.spelt.append(piece.replace(SPACE, " ").encode())
        self.agenda = Agenda(self.ids, self.merges)
        self.forget()

    def forget(self) -> None:
        """Start with an empty memory."""
        self.known: dict[str, int] = {}
        # of all known cuts one behind another: places and pieces of merges without dropout, and ids
        self.paths, self.plain = Pool(np.uint64), Pool(np.uint32)

    def keys(self, start: int, n: int) -> np.ndarray:
        """The keys of the first n cuts of a document."""
        base = common.mix(np.array([start & _WORD], np.uint64) ^ common.mix(np.array([self.seed & _WORD], np.uint64)))
        return common.mix(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def skipped(self, key: int, what: int) -> bool:
        """Whether the key makes this merge (its place and piece) be skipped."""
        h = (key ^ what) * 0x9E3779B97F4A7C15 & _WORD
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & _WORD
        return (h ^ (h >> 32)) & 0xFFFFFFFF < self.dropout

    def all_skipped(self, keys: np.ndarray, what: np.ndarray) -> np.ndarray:
        """``skipped`` for arrays."""
        h = (keys ^ what) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF) < np.uint64(self.dropout)

    def cut_ids(self, cut: str, key: int, dropout: bool = True, path: list | None = None) -> list[int]:
        """The ids of one cut (blanks written as they are); ``path`` gets the places and pieces of its merges."""
        # a text's own U+2581 is spelt in bytes, so that it does not come back as a blank
        symbols: list[str | None] = [*(cut.replace(SPACE, FOREIGN) if SPACE in cut else cut).replace(" ", SPACE)]
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in merges:
                agenda.append((merges[piece], i, piece))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            if symbols[i] is None or (j := after[i]) >= n or symbols[i] + symbols[j] != piece:
                continue  # one of the two is merged already
            what = i << 16 ^ self.ids[piece]
            if dropout and self.skipped(key, what):
                continue
            if path is not None:
                path.append(what)
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wider = piece + symbols[k]
                if wider in merges:
                    heapq.heappush(agenda, (merges[wider], i, wider))
            if (k := before[i]) >= 0:
                wider = symbols[k] + piece
                if wider in merges:
                    heapq.heappush(agenda, (merges[wider], k, wider))
        out = []
        for s in symbols:
            if s is not None:
                found = self.ids.get(s)
                if found is None:
                    out += [self.byte[b] for b in s.replace(FOREIGN, SPACE).encode()]
                else:
                    out.append(found)
        return out

    def encode_all(self, texts: list[str], starts: list[int]) -> list[bytes]:
        """``encode`` of many texts, in passes of about PASS_CUTS cuts."""
        out: list[bytes] = []
        held, cuts = [], []
        for text, start in zip(texts, starts, strict=True):
            own = _CUT.findall(" " + text) if text else []
            if cuts and len(cuts) + len(own) > PASS_CUTS:
                out += self.one_pass(cuts, held)
                held, cuts = [], []
            held.append((start, len(own)))
            cuts += own
        return out + self.one_pass(cuts, held)

    def one_pass(self, cuts: list[str], held: list[tuple[int, int]]) -> list[bytes]:
        """Ids of texts, given as (start, number of cuts), from all of their cuts."""
        if not cuts:
            return [b""] * len(held)
        if len(self.known) > REMEMBERED:
            self.forget()
        self.learn(cuts)
        keys = np.concatenate([self.keys(*h) for h in held])
        which = np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts))
        start, length = self.plain.start(which), self.plain.size(which)
        pools = [self.plain.all()]
        if self.dropout:
            merges = self.paths.size(which)
            what = self.paths.all()[ranges(self.paths.start(which), merges)]
            skip = np.r_[0, np.cumsum(self.all_skipped(np.repeat(keys, merges), what))]
            end = np.cumsum(merges)
            varied = np.flatnonzero(skip[end] > skip[end - merges])
            own = [cuts[i] for i in varied.tolist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            for i in np.flatnonzero(sizes > LONGEST).tolist():
                ids = np.array(self.cut_ids(own[i], int(keys[varied[i]])), np.uint32)
                start[varied[i]], length[varied[i]] = sum(map(len, pools)), len(ids)
                pools.append(ids)
            at = np.flatnonzero(sizes <= LONGEST)
            for at in np.array_split(at[np.argsort(sizes[at], kind="stable")], 1 + len(at) // ROWS):
                if len(at):
                    symbols, n, _ = self.agenda.work([own[i] for i in at.tolist()], sizes[at], lambda row, what, k=keys[varied[at]]: self.all_skipped(k[row], what))
                    ids, n = self.spelled(symbols, n)
                    length[varied[at]] = n
                    start[varied[at]] = sum(map(len, pools)) + np.cumsum(n) - n
                    pools.append(ids)
        ids = np.concatenate(pools)[ranges(start, length)]
        cut = np.cumsum([0, *[n for _, n in held]])
        edge = np.r_[0, np.cumsum(length)][cut]
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]

    def learn(self, cuts: list[str]) -> None:
        """Remember cuts that are not known yet."""
        new = [c for c in dict.fromkeys(cuts) if c not in self.known]
        short = sorted((c for c in new if len(c) <= LONGEST), key=len)
        for at in range(0, len(short), ROWS):
            own = short[at : at + ROWS]
            symbols, n, done = self.agenda.work(own, np.fromiter(map(len, own), np.int64, len(own)), None)
            self.known.update(zip(own, range(len(self.known), len(self.known) + len(own)), strict=True))
            self.plain.add(*self.spelled(symbols, n))
            row, what = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
            self.paths.add(what[np.argsort(row, kind="stable")].astype(np.uint64), np.bincount(row, minlength=len(own)))
        for c in new:
            if len(c) > LONGEST:
                path: list[int] = []
                ids = self.cut_ids(c, 0, False, path)
                self.known[c] = len(self.known)
                self.plain.add(np.array(ids, np.uint32), np.array([len(ids)]))
                self.paths.add(np.array(path, np.uint64), np.array([len(path)]))

    def spelled(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each cut) from symbols; those that are no pieces are spelt in bytes."""
        strange = np.flatnonzero(symbols >= self.agenda.pieces)
        if len(strange) == 0:
            return symbols.astype(np.uint32), n
        parts = [[self.byte[b] for b in chr(c).encode()] for c in (symbols[strange] - self.agenda.pieces).tolist()]
        size = np.ones(len(symbols), np.int64)
        size[strange] = [len(p) for p in parts]
        ids = np.repeat(symbols, size).astype(np.uint32)
        first = np.cumsum(size) - size
        ids[ranges(first[strange], size[strange])] = [b for p in parts for b in p]
        edge = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
        return ids, np.diff(edge)

    def encode(self, text: str, start: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``start`` stands for the document in the keys."""
        return self.encode_all([text], [start])[0]

    def decode(self, ids: bytes) -> str:
        """The text of some ids."""
        spelt = self.spelt
        return b"".join([spelt[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()[1:]


def load(path: str, dropout: float, seed: int) -> Codec:
    """The codec of a worker."""
    key = path, dropout, seed
    if key not in _LOADED:
        _LOADED[key] = Codec(path, dropout, seed)
    return _LOADED[key]


def starts(ids: list) -> list[int]:
    """What stands for each document in the keys, from its id."""
    return [0 if d is None else int.from_bytes(hashlib.blake2b(str(d).encode(), digest_size=8).digest(), "little") for d in ids]


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with ids (array of int); a column of that name is replaced, others are kept.

    Null and empty texts have no ids. Equal rows (by doc_id and text) get equal ids, rows with a null
    doc_id have one key, and empty tables give no rows.
    """
    common.prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != "ids"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        codec = load(path, dropout, seed)
        for batch in batches:
            texts, own = [t or "" for t in batch.column(names.index("text")).to_pylist()], starts(batch.column(names.index("doc_id")).to_pylist())
            ids = [np.frombuffer(x, "<i4") for x in codec.encode_all(texts, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

    return docs.select(names).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in names) + ", ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded, the text that ``ids`` spell; null ids give a null."""
    names = [c for c in encoded.columns if c != "decoded"]
    fields = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def run(batches):
        codec = load(path, 0.0, 0)
        for batch in batches:
            texts = [None if ids is None else codec.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(names).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in names) + ", decoded string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: doc_id, n_tokens, ids_crc32, lossless."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    common.prepare(spark)
    path = model_path()

    def digest(batches):
        codec = load(path, DROPOUT, SEED)
        for batch in batches:
            docs_in, texts = list(tokens.column(batch, "doc_id")), [t or "" for t in tokens.column(batch, "text")]
            found = zip(docs_in, texts, codec.encode_all(texts, starts(docs_in)), strict=True)
            rows = [(d, len(ids) // 4, zlib.crc32(ids), codec.decode(ids) == t) for d, t, ids in found]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
