"""Token ids by stretches against the tokenizers library."""

import json
import random

import numpy as np
import pyarrow as pa
import tokenizers
from tokenizers import Tokenizer

from tests.llm.test_prefix_bpe import texts
from tidewatch.llm import tokens

PATH = tokens.vocabulary_path()


def words(n: int) -> list[str]:
    """Words with and without marks, in texts of twenty."""
    draw = random.Random(5)
    made = ["".join(draw.choice("aeinrstäßéñ") for _ in range(draw.randrange(2, 12))) + draw.choice(["", "", ".", ",", "!!", "***"]) for _ in range(n)]
    return ["".join(w + draw.choice([" ", " ", " ", "\n"]) for w in made[k : k + 20]) for k in range(0, n, 20)]


def same(given: list[str | None], path: str = PATH) -> None:
    library = Tokenizer.from_file(path)
    got = tokens.encode(given, path)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch([x or "" for x in given], add_special_tokens=False)]
    assert tokens.encode(pa.array(given, pa.string()), path) == got


def test_ids_of_the_library():
    draw = random.Random(3)
    blanks = ["".join(draw.choice(["a", "Éa", "b.", "'s", "9", " ", "  ", "\n", "\n\n", " \n", "\n ", "   "]) for _ in range(draw.randrange(9))) for _ in range(4000)]
    same([*texts(), *blanks, *words(3000), *(a + b + c for a in ("", " ", "\n", "  ", "\n\n ") for b in ("", "x", "ab cd", "a\n\nb") for c in ("", " ", "\n", "  ", " \n\n"))])
    assert tokens.encode([], PATH) == []


def test_small_memories(monkeypatch):
    monkeypatch.setattr(tokens, "_LOADED", {})
    for name, small in (("REMEMBERED", 6), ("KEPT_CHARS", 3), ("PASS_BYTES", 40), ("JOINED", 2)):
        monkeypatch.setattr(tokens, name, small)
    same([*texts()[:400], *words(400)])
    held = tokens._LOADED[PATH]
    assert max(map(len, [*held.known, *held.older])) <= 3


def test_new_words_are_given_to_the_library_together(monkeypatch):
    """One call of the library for each new word was most of the time of op2 and op9."""
    calls = []

    class Counted:
        def __init__(self, held):
            self.held = Tokenizer(held.held) if isinstance(held, Counted) else held

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            calls.append(name)
            found = getattr(self.held, name)
            return Counted(found) if name == "model" else found

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(tokens, "_LOADED", {})
    tokens.encode(["a"], PATH)
    calls.clear()
    tokens.encode(words(2000), PATH)
    assert len(calls) <= 4


def test_a_vocabulary_whose_tokens_cross_borders(tmp_path):
    """Words must not be put together for a model that would merge them."""
    letters = [chr(c) for c in tokens._LETTERS.values()]
    space = chr(tokens._LETTERS[32])
    for left, right in (("a", space), ("b", "."), (chr(tokens._LETTERS[10]), "a")):
        path = tmp_path / f"{ord(left)}.json"
        kind = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        model = {"type": "BPE", "vocab": {t: k for k, t in enumerate([*letters, left + right])}, "merges": [[left, right]]}
        path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": kind, "post_processor": None, "decoder": kind, "model": model}))
        same(["a a b. ab.\na b", "ba. a\na"], str(path))
        assert not tokens._LOADED[str(path)].apart
    assert tokens._load(PATH).apart


def test_columns_of_batches_need_not_become_lists():
    """op2 and op9 hand the column over as it comes, and a part of a column is read as such."""
    given = ["no", None, "", "ab cd.\nef", "x\ty", "a   b", " "]
    want = [ids + np.array([tokens.END_ID], "<u4").tobytes() for ids in tokens.encode(given, PATH)]
    for kind in (pa.string(), pa.large_string()):
        assert tokens.with_end(pa.array(given, kind), PATH) == want
        assert tokens.with_end(pa.array(given, kind).slice(2, 3), PATH) == want[2:5]
