"""Token ids of whole texts by the tokenizers library, each distinct stretch of a text encoded once."""

from __future__ import annotations

import os
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id put after each document.
END_ID = 2
#: Distinct stretches that a Python worker remembers. At half of it, those that were not met since the last time are given up.
REMEMBERED = 600_000
#: The longest stretch that is remembered beyond its pass.
KEPT_CHARS = 100
#: Bytes of text that are encoded together; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
#: Words that the library's model is given as one string.
JOINED = 100
#: A byte-level pre-tokenizer never joins a character other than white space with white space behind
#: it, so ids of such stretches put together are the ids of the whole text.
_STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space, and what special tokens are written with: such texts are encoded whole.
_WHOLE = r"<\||[" + "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Of blanks in a row the pre-tokenizer takes the last for itself or with the word behind it, and those before it together;
#: where there are at most two, each is cut off, but for those at the end of a text.
_RUN = r"[ \n]{3}|\A[ \n]{2}|[ \n]{2}\z"
#: A word that the pre-tokenizer leaves whole, in letters that every version of Unicode calls so, and marks behind it.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ſ가-힣", "!-/:-@[-`{-~"
_PLAIN = re.compile(f"\n?[{_LETTER}]+[{_MARK}]*")
_LOADED: dict[str, Words] = {}


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write a byte: visible Latin-1 characters as they are, the others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def vocabulary_path() -> str:
    """Where the byte-level vocabulary is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """The library's tokenizer and what it gave for stretches of texts.

    A stretch is known by its letters; one that starts with a blank other than a single space has it in front.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: the same model without the pre-tokenizer, for words that this would leave whole
        self.model = Tokenizer(self.tokenizer.model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.letters = np.array([_LETTERS[b] for b in range(256)], "<u2")
        blank, feed = f"{chr(_LETTERS[32])}{chr(_LETTERS[10])}", chr(_LETTERS[10])
        of = {chr(_LETTERS[b]) for b in "".join(re.findall(f"[{_LETTER}]", "".join(map(chr, range(0xD800))))).encode()}
        crossing = re.compile(f"[^{blank}][{blank}]|{feed}[^{blank}]|[{''.join(of)}][{_MARK}]")
        spelt = {*blank, *of, *re.findall(f"[{_MARK}]", "".join(map(chr, range(128))))}
        #: whether plain words with a blank in front may stand side by side: every byte has an id, and no token that is made of their bytes crosses a border
        self.apart = not self.tokenizer.model.ignore_merges and vocabulary.keys() >= set(map(chr, _LETTERS.values())) and not any(map(crossing.search, filter(spelt.issuperset, vocabulary)))
        self.feed = len(self.whole(["\n"])[0])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give up what is remembered."""
        self.known.clear()
        self.older.clear()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library as it is."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with one blank in front and none inside: many are given to the model at once, and its ids are cut by the bytes they stand for."""
        if not words:
            return []
        data = np.frombuffer("".join(words).encode(), np.uint8)
        spelt = self.letters[data].tobytes().decode("utf-16-le")
        edges = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))
        cuts = [*edges[:-1:JOINED].tolist(), len(data)]
        found = self.model.encode_batch_fast([spelt[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        ends = np.searchsorted(np.append(0, np.cumsum(self.size[ids])), edges).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, keys: list[str]) -> None:
        """Ids of stretches that are not known yet."""
        self.known.update((k, self.older[k]) for k in keys if k in self.older)
        keys = [k for k in keys if k not in self.older]
        plain = [k for k in keys if self.apart and _PLAIN.fullmatch(k)]
        self.known.update(zip(plain, self.plain([k if k[0] == "\n" else " " + k for k in plain]), strict=True))
        rest = [k for k in keys if k not in self.known]
        self.known.update(zip(rest, self.whole([k if k.startswith((" ", "\n")) else " " + k for k in rest]), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts (large strings, none null), in one pass. Each is cut with a line feed in front, whose ids are its own."""
        odd = pc.match_substring_regex(texts, _WHOLE)
        runs = pc.and_not(pc.match_substring_regex(texts, _RUN), odd)
        rest = pc.invert(pc.or_(odd, runs))
        feed, tab, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", "\t", ""))
        spaced = pc.binary_join_element_wise(feed, pc.replace_substring(texts.filter(rest), "\n", " \n"), nothing)
        cut = pc.split_pattern(spaced, " ")
        long = pa.array([stretches(text) for text in texts.filter(runs).to_pylist()], cut.type)
        coded = pa.concat_arrays([cut.flatten(), long.flatten()]).dictionary_encode()
        # no stretch has a tab in it
        keys = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), tab)[0].as_py().split("\t") if len(coded) else []
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        fresh = [*filterfalse(self.known.__contains__, keys)]
        self.learn(fresh)
        found = [*map(self.known.__getitem__, keys)]
        for key in fresh:
            if len(key) > KEPT_CHARS:
                del self.known[key]

        out: list[bytes] = [b""] * len(texts)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = coded.indices.to_numpy()
        each = size[place]
        ends = np.append(0, np.cumsum(each))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(size) - size)[place] - ends[:-1], each) + np.arange(ends[-1])]
        counts = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (cut, long)]).astype(np.int64)
        edges = 4 * ends[np.append(0, np.cumsum(counts))]
        raw = ids.tobytes()
        rows = np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (rest, runs)])
        for i, a, b in zip(rows.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[i] = raw[a + self.feed : b]
        for i, ids in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), self.whole(texts.filter(odd).to_pylist()), strict=True):
            out[i] = ids
        return out


def stretches(text: str) -> list[str]:
    """A text that is not empty as stretches by the keys of ``Words``, with a line feed in front."""
    parts = [p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p for p in _STRETCH.findall(text)]
    return ["\n", *parts] if text[0] in " \n" else ["\n" + parts[0], *parts[1:]]


def _load(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def forget() -> None:
    """Give back what this process remembers of words."""
    for words in _LOADED.values():
        words.forget()


def encode(texts: list[str | None] | pa.Array, path: str) -> list[bytes]:
    """Of each text its ids as little-endian unsigned 32-bit integers; a null text is an empty one."""
    words, out = _load(path), []
    column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PASS_BYTES, "right")))
        out += words.encode(column.slice(first, last - first))
        first = last
    return out


def with_end(texts: list[str | None] | pa.Array, path: str, end_id: int = END_ID) -> list[bytes]:
    """As ``encode``, with the end id behind each document."""
    end = np.array([end_id], "<u4").tobytes()
    return [ids + end for ids in encode(texts, path)]


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of a batch as a list."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
