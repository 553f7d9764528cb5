"""Byte-level BPE by walking a trie of distinct words, and decoding.

The ids of a word are fixed by the last id of each of its prefixes: the last id ``t`` of a prefix is the one
token that ends it and stands next to the last id of what is before it without either being merged
differently. Words with a common beginning share these states. So the distinct words of a pass are put
into a trie, and a depth-first walk carries the states of the path to its node: a shared prefix is
worked out once, however many words have it. A word's ids are read off its path from behind.

Two tokens may stand side by side if the merges, applied in their order to the bytes of both, never merge
across the border. That is read off the two chains of parts next to the border (``Merges.apart``), and
remembered for pairs that were met.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, tokens

#: Stretches, words and pairs that a Python worker remembers; beyond it a memory is emptied and filled anew.
STRETCHES, WORDS, PAIRS = 1_000_000, 700_000, 600_000
#: The longest stretch or word that is remembered beyond its pass.
KEPT_CHARS = 100
#: Characters of text whose new words share a trie; a longer text is a pass of its own.
PASS_CHARS = 4 << 20
#: A stretch whose words are plain to see: a line feed, letters that every version of Unicode calls so behind one space or none, ASCII marks.
_PLAIN = re.compile("(\n?)( ?[A-Za-zÀ-ÖØ-öø-ſ가-힣]+)([!-/:-@[-`{-~]*)")
#: White space that the pre-tokenizer may join across stretches.
_BLANK = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_LOADED: dict[tuple, Encoder] = {}


class Merges:
    """A byte-level vocabulary: what tokens are made of, what ends a prefix, and what may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.ids: dict[str, int] = held["model"]["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.spelt: dict[int, str] = {i: t for t, i in self.ids.items()}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.size = [0] * size
        for token, i in self.ids.items():
            self.size[i] = len(token)
        #: (left, right) -> when the two are merged; of each token when it is made, and of what
        self.rank: dict[tuple[int, int], int] = {}
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for n, pair in enumerate(held["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[i, j] = n
            if self.left[k] < 0:
                self.made[k], self.left[k], self.right[k] = n, i, j
        #: the tokens by their letters from behind: letter -> (token or -1, deeper letters)
        self.endings: dict = {}
        for token, i in self.ids.items():
            if len(token) > 1 and self.left[i] < 0 or not self.whole(i):
                continue  # no merge gives it
            level = self.endings
            for letter in token[:0:-1]:
                level = level.setdefault(letter, [-1, {}])[1]
            level.setdefault(token[0], [-1, {}])[0] = i
        self.bytes = self._bytes(size)
        self.met: dict[int, bool] = {}

    def _bytes(self, size: int) -> list[bytes]:
        """What each id stands for."""
        back = {chr(c): b for b, c in tokens._LETTERS.items()}
        out = [b""] * size
        for token, i in [*self.ids.items(), *self.added.items()]:
            out[i] = bytes([back[c] for c in token]) if all(c in back for c in token) else token.encode()
        return out

    def whole(self, token: int) -> bool:
        """Whether the token's bytes give the token again."""
        return self.left[token] < 0 or (self.apart(self.left[token], self.right[token], self.made[token]) and self.whole(self.left[token]) and self.whole(self.right[token]))

    def apart(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether the bytes of a and b, merged together up to the merge ``until`` (all, without it), stay these two tokens.

        Next to the border there are the last part of a and the first part of b. Each part lives from the
        merge that makes it to the merge that uses it up; the border is lost if two parts that live at
        the same time have a merge that comes before both of these. Of equal merges the left one is first.
        """
        end = len(self.rank) if until is None else until
        a_used = b_used = end
        while True:
            merge = self.rank.get((a, b))
            if merge is not None and merge < a_used and (merge <= b_used if b_used < end else merge < end):
                return False
            if self.made[a] < 0 and self.made[b] < 0:
                return True
            if self.made[a] > self.made[b]:
                a_used, a = self.made[a], self.right[a]
            else:
                b_used, b = self.made[b], self.left[b]

    def beside(self, a: int, b: int) -> bool:
        """``apart``, remembered."""
        key = a << 32 | b
        known = self.met.get(key)
        if known is None:
            if len(self.met) > PAIRS:
                self.met.clear()
            known = self.met[key] = self.apart(a, b)
        return known


class _Node:
    """A branch of the trie: the letters that lead to it, the words below it by their next letter, and whether a word ends here."""

    __slots__ = ("letters", "below", "ends")

    def __init__(self, letters: str, below: dict | None, ends: bool):
        self.letters, self.below, self.ends = letters, below, ends


class Trie:
    """Distinct words; beginnings that several share are there once."""

    def __init__(self):
        self.root = _Node("", {}, False)

    def insert(self, word: str) -> None:
        """Add a word that is not empty."""
        node, at = self.root, 0
        while at < len(word):
            if node.below is None:
                node.below = {}
            child = node.below.get(word[at])
            if child is None:
                node.below[word[at]] = _Node(word[at:], None, True)
                return
            same = len(child.letters)
            if not word.startswith(child.letters, at):
                same = len(os.path.commonprefix([child.letters, word[at : at + same]]))
                upper = _Node(child.letters[:same], {child.letters[same]: child}, False)
                child.letters = child.letters[same:]
                node.below[word[at]] = child = upper
            node, at = child, at + same
        node.ends = True

    def encode(self, merges: Merges):
        """(word, ids) of every word, the walk going depth first."""
        endings, beside, size = merges.endings, merges.beside, merges.size
        path: list[str] = []  # letters from the root to the node
        last: list[int] = []  # the last id of each prefix of the path
        stack = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            del path[depth:], last[depth:]
            for letter in node.letters:
                path.append(letter)
                at, level = len(path) - 1, endings
                while True:
                    found, level = level[path[at]]
                    if found >= 0 and (at == 0 or beside(last[at - 1], found)):
                        last.append(found)
                        break
                    at -= 1
            if node.ends:
                ids, at = [], len(path)
                while at:
                    ids.append(last[at - 1])
                    at -= size[ids[-1]]
                yield "".join(path), np.array(ids[::-1], "<u4").tobytes()
            if node.below:
                stack += [(child, len(path)) for child in node.below.values()]


class Encoder:
    """Texts to ids and back; ``special``: whether added tokens in a text are taken for themselves."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.merges = Merges(path)
        #: cuts a text into words and writes their bytes as letters; the merges are ours
        self.words_of = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = sorted(self.merges.added, key=len, reverse=True) if special else []
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def spelled(self, part: str) -> list[str]:
        """The words of a piece of text, in letters for bytes."""
        if plain := _PLAIN.fullmatch(part):
            return [x.encode().decode("latin-1").translate(tokens._LETTERS) for x in plain.groups() if x]
        return [word for word, _ in self.words_of(part)]

    def parts(self, text: str) -> list[str]:
        """A text cut where the pre-tokenizer cuts it whatever is around."""
        if self.added is not None and (found := self.added.split(text))[1:]:
            return [x for k, part in enumerate(found) for x in ([part] if k % 2 else self.parts(part) if part else [])]
        return [text] if _BLANK.search(text) else tokens._STRETCH.findall(text)

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of stretches: their new words are put into one trie and encoded together."""
        if len(self.words) > WORDS:
            self.words.clear()
        split = {p: self.spelled(p) for p in parts}
        trie = Trie()
        for own in split.values():
            for word in own:
                if word not in self.words:
                    trie.insert(word)
        fresh = dict(trie.encode(self.merges))
        self.words.update(fresh)
        found = {p: b"".join([self.words[w] for w in own]) for p, own in split.items()}
        for word in fresh:
            if len(word) > KEPT_CHARS:
                del self.words[word]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers; null texts have none."""
        out: list[bytes] = []
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self.parts(text) if text else [])
            chars += len(text or "")
            if chars > PASS_CHARS:
                out += self.one_pass(held)
                held, chars = [], 0
        return out + self.one_pass(held)

    def one_pass(self, held: list[list[str]]) -> list[bytes]:
        """Ids of texts that are given as their parts."""
        known = self.stretches
        if len(known) > STRETCHES or not known:
            known.clear()
            if self.added is not None:
                known.update((t, np.array([i], "<u4").tobytes()) for t, i in self.merges.added.items())
        fresh = self.learn(list({p for parts in held for p in parts if p not in known}))
        known.update(fresh)
        out = [b"".join([known[p] for p in parts]) for parts in held]
        for part in fresh:
            if len(part) > KEPT_CHARS:
                del known[part]
        return out

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        table = self.merges.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def load(path: str, special: bool = True) -> Encoder:
    """The encoder of a worker."""
    key = path, special
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, special)
    return _LOADED[key]


def _mapped(docs: DataFrame, new: str, kind: str, of: str, f) -> DataFrame:
    """``docs`` with a column ``new``, f of the batches of the column ``of``; a column of that name is replaced."""
    common.prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != new]
    fields = {x.name: x.dataType.simpleString() for x in docs.schema.fields}

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, f(batch.column(names.index(of)).to_pylist())], [*names, new])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in names) + f", `{new}` {kind}")


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """``docs`` with ids (array of int); a column of that name is replaced, others are kept.

    Null and empty texts have no ids. Rows are encoded one by one: repeated rows and null ids make no difference,
    and empty tables give no rows.
    """
    return _mapped(docs, "ids", "array<int>", "text", lambda texts: pa.array([np.frombuffer(x, "<i4") for x in load(path, special).encode(texts)], pa.list_(pa.int32())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded, the text that ``ids`` stand for; null ids give a null."""

    def texts(rows):
        codec = load(path)
        return pa.array([None if ids is None else codec.decode(np.array(ids, "<u4").tobytes()) for ids in rows], pa.string())

    return _mapped(encoded, "decoded", "string", "ids", texts)


def op11_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common.prepare(spark)
    path = tokens.vocabulary_path()

    def digest(batches):
        codec = load(path)
        for batch in batches:
            found = codec.encode(tokens.column(batch, "text"))
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()) for ids in found]
            kinds = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(common.released(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
