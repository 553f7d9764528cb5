"""BPE by a trie against the tokenizers library."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import common, prefix_bpe, tokens

SF = "/root/testdata/sf0.001"
LETTERS = ["e", "n", "th", "er", " ", "  ", "\n", "é", "中", "한", "\U0001f600", "\x00", "1", "ing", "t", "\t", "\x85", "\x1c", "　", "'s", "'", "aa", "=", "--", "<|endoftext|>", "<|", "\xa0", "\r\n", "."]


def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def texts():
    draw = random.Random(2)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))) for _ in range(2000)]
    made += ["".join(draw.choice("ae =-") for _ in range(draw.randrange(40))) for _ in range(2000)]
    return [*made, None, "", "a" * 1001, "=" * 999, " " * 500, "ab" * 3000, "word\tword " * 50, "Zusammenhängende Wörter 123 456!!!"]


def test_ids_and_texts_of_the_library():
    t, codec, given = library(), prefix_bpe.Encoder(tokens.vocabulary_path()), texts()
    for text, ids, want in zip(given, codec.encode(given), t.encode_batch([x or "" for x in given], add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert codec.decode(ids) == t.decode(want.ids, skip_special_tokens=False) == (text or "")


def test_added_tokens_as_plain_text():
    t = library()
    t.encode_special_tokens = True
    given = ["a<|endoftext|>b", "<|endoftext|>"]
    got = prefix_bpe.Encoder(tokens.vocabulary_path(), special=False).encode(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in given]


def test_broken_bytes_are_decoded_as_the_library_does():
    t, codec, draw = library(), prefix_bpe.load(tokens.vocabulary_path()), random.Random(8)
    for _ in range(500):
        ids = [draw.choice([draw.randrange(256), draw.randrange(50257)]) for _ in range(draw.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_small_memories(monkeypatch):
    given = texts()[:300]
    want = prefix_bpe.Encoder(tokens.vocabulary_path()).encode(given)
    for name, small in (("STRETCHES", 5), ("WORDS", 5), ("PAIRS", 3), ("PASS_CHARS", 50), ("KEPT_CHARS", 2)):
        monkeypatch.setattr(prefix_bpe, name, small)
    assert prefix_bpe.Encoder(tokens.vocabulary_path()).encode(given) == want


def test_a_shared_prefix_is_walked_once(monkeypatch):
    codec, steps = prefix_bpe.Encoder(tokens.vocabulary_path()), []
    trie = prefix_bpe.Trie()
    words = ["stand", "standing", "standings", "stone", "s"]
    for w in [*words, *words]:
        trie.insert(w)

    class Counted(dict):
        def __getitem__(self, key):
            steps.append(key)
            return super().__getitem__(key)

    codec.merges.endings = Counted(codec.merges.endings)
    got = dict(trie.encode(codec.merges))
    # each node of the trie looks for its last id from the root of the endings once
    assert set(got) == set(words) and len(steps) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in got.items()} == {w: [i.id for i in library().model.tokenize(w)] for w in words}


def test_a_vocabulary_with_tokens_that_no_merge_gives(tmp_path):
    """A token whose parts are merged otherwise before it comes is never an end."""
    path = tmp_path / "small.json"
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5, "aa": 6, "aaa": 7}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"], ["a", "a"], ["aa", "a"]]}
    import json

    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": model}))
    t, draw = Tokenizer.from_file(str(path)), random.Random(1)
    given = ["".join(draw.choice("abc") for _ in range(draw.randrange(12))) for _ in range(500)]
    got = prefix_bpe.Encoder(str(path)).encode(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x).ids for x in given]


def test_columns_and_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (1, None), (2, ""), (3, "x<|endoftext|>y"), (3, "x<|endoftext|>y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("decoded", F.lit(1)).withColumn("a b", F.lit(2))
    got = prefix_bpe.decode(prefix_bpe.encode(docs, tokens.vocabulary_path()), tokens.vocabulary_path())
    assert set(got.columns) == {"doc_id", "text", "ids", "decoded", "a b"}
    want = brute.token_ids([t for _, t in rows], tokens.vocabulary_path(), end=0)
    assert sorted(map(str, ((r.doc_id, r.decoded, r.ids) for r in got.collect()))) == sorted(map(str, ((d, t or "", x[:-1]) for (d, t), x in zip(rows, want, strict=True))))
    assert prefix_bpe.encode(docs.limit(0), tokens.vocabulary_path()).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert prefix_bpe.decode(nothing, tokens.vocabulary_path()).first().decoded is None


def test_query(spark):
    docs = [(r.doc_id, r.text or "") for r in common.read(spark, SF, "documents").collect()]
    ids = brute.token_ids([t for _, t in docs], tokens.vocabulary_path(), end=0)
    want = {d: (len(x) - 1, hashlib.sha256(np.array(x[:-1], "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (d, t), x in zip(docs, ids, strict=True)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.op11_prefix_bpe(spark, SF).collect()} == want
