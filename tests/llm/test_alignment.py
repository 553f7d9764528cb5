"""Alignment of two tokenizers against a plain version over the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import alignment, common, prefix_bpe, sentencepiece_codec, tokens

SF = "/root/testdata/sf0.001"
LETTERS = ["e", "n", "th", "er", " ", "  ", "\n", "é", "中", "한", "\U0001f600", "\x00", "1", "ing", "t", "\t", "'s", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\xa0", "."]
NOTHING = (0, 0, 0, 0, 0, 0, "")


def paths():
    return tokens.vocabulary_path(), sentencepiece_codec.model_path()


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a, b = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    a.encode_special_tokens = True
    byte = {chr(letter): value for value, letter in tokens._LETTERS.items()}

    def spelled_a(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def spelled_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        own = [[spelled_a(i) for i in ids_a], [spelled_b(i) for i in ids_b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in own):
            found.append(None)
            continue
        groups, group, at = [], ([], []), [0, 0]
        left = [list(zip(ids, map(len, x), strict=True)) for ids, x in zip((ids_a, ids_b), own, strict=True)]
        while left[0] or left[1]:
            side = 0 if at[0] <= at[1] and left[0] else 1
            i, n = left[side].pop(0)
            group[side].append(i)
            at[side] += n
            if at[0] == at[1]:
                groups.append(group)
                group = ([], [])
        found.append((len(ids_a), len(ids_b), groups))
    count = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    most = defaultdict(int)
    for (_, i), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for f in found:
        if not f:
            out.append(NOTHING)
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])
        out.append((f[0], f[1], len(f[2]), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(line.encode()).hexdigest()))
    return out


def result(frame):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in frame.collect()]


def run(docs):
    both = alignment.load(*paths())
    return alignment.rated(alignment.align(docs, *paths()), both.n_b)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    assert dict(result(alignment.op13_tokenizer_alignment(spark, SF))) == dict(zip([d for d, _ in docs], plain([t for _, t in docs]), strict=True))


def test_odd_texts(spark, monkeypatch):
    """Null, empty, blank and long texts, marks of both tokenizers in texts, repeated rows, missing ids, clashing names."""
    draw = random.Random(2)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "x", "a ▁ b", "▁", "a" * 1001, "word\tword " * 300, "中" * 400, "same words here", "same words here", " ".join(f"w{i}" for i in range(20_000))]
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("n_a", "links", "pair", "n_best")]).repartition(3)
    want = sorted(zip([str(d) for d, _ in rows], plain(texts), strict=True))
    assert sorted((str(d), r) for d, r in result(run(docs))) == want
    assert sum(r != NOTHING for _, r in want) > 290 and run(docs.limit(0)).count() == 0


def test_memories_that_are_emptied(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(90))) for _ in range(200)]
    want = alignment.aligned(alignment.Both(*paths()), texts)
    monkeypatch.setattr(alignment, "STRETCHES", 3)
    monkeypatch.setattr(alignment, "CUT_CHARS", 5)
    monkeypatch.setattr(prefix_bpe, "KEPT_CHARS", 4)
    both = alignment.Both(*paths())
    assert [alignment.aligned(both, [t])[0] for t in texts] == want


def test_pairs_are_bounded_by_the_bytes_of_both_vocabularies(spark):
    both = alignment.load(*paths())
    table = alignment.align(common.read(spark, SF, "documents"), *paths())
    for r in alignment.pair_counts(table).collect():
        a, b = both.spelt[0][r.pair // both.n_b], both.spelt[1][r.pair % both.n_b]
        assert a.endswith(b) or b.endswith(a)
    assert sum(map(int, both.size[0])) + sum(map(int, both.size[1])) < 600_000
