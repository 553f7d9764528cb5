"""The ten operators against plain versions, on small tables and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import binary_output, common, embedding_dedup, jaccard_join, labelled, license_scan, packing, quality_model, quality_rules, sentencepiece_codec, substring_dedup, tokens, toxicity

SF = "/root/testdata/sf0.001"
#: Large enough for some hundred documents of the rarer label to learn from.
LABELLED = "/root/testdata/sf0.1"
#: Extra columns with names that the operators use themselves.
CLASHING = ["score", "component_id", "h", "n", "shard", "piece", "kept", "posterior", "words", "ids"]


def odd_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    body = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = body(30_000)
    near = passage.split()
    near[-1] = "other"
    return [
        (0, passage), (1, None), (2, ""), (3, " \t\n\x0b "), (4, passage), (5, body(40) + " " + passage + "\n" + body(30)), (6, long), (7, long + " tail"),
        (8, " ".join(near)), (9, "one two"), (10, "one two"), (11, "ONE two"), (12, "a b c d 가나 다라 #%"), (13, "same " * 100), (14, "same " * 130), (15, "x"), (16, passage.upper()),
        (17, "line a\nline a\nline b\n\n\nline a"), (18, "▁ odd ▁▁ \U0001f600 é́ <|endoftext|>"), (20, body(200)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_texts(), "doc_id long, text string")
    for k, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(k))
    return df.repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def table_of(spark, tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_substrings(spark, tmp_path, odd, pairs):
    want = brute.substring(pairs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op3_substring_dedup(spark, SF).collect()} == want
    got = substring_dedup.op3_substring_dedup(spark, table_of(spark, tmp_path, odd)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring(odd_texts())


def test_jaccard(spark, tmp_path, odd, pairs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op4_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute.jaccard(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op4_ngram_jaccard_join(spark, table_of(spark, tmp_path, odd)).collect()}
    assert got == brute.jaccard(odd_texts())


def test_jaccard_at_the_threshold(spark, tmp_path):
    """Chains of near copies around the limit, with shingles that very many documents share."""
    rng = random.Random(9)
    head = [f"h{i}" for i in range(40)]
    rows = [(i, " ".join(head[: rng.randint(20, 40)] + [f"t{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))])) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op4_ngram_jaccard_join(spark, table_of(spark, tmp_path, df)).collect()}
    assert got == brute.jaccard(rows)


def em(rows):
    """The posterior of vote patterns by plain expectation-maximisation."""
    k = len(quality_rules.RULES)
    prior, good, bad = quality_rules.PRIOR, [quality_rules.RIGHT_GOOD] * k, [quality_rules.RIGHT_BAD] * k

    def posterior(v):
        s = math.log(prior / (1 - prior))
        for j in range(k):
            s += {1: lambda: math.log(good[j] / (1 - bad[j])), -1: lambda: math.log((1 - good[j]) / bad[j]), 0: lambda: 0.0}[v[j]]()
        return 1 / (1 + math.exp(-s))

    for _ in range(quality_rules.ROUNDS):
        q = [posterior(v) for v in rows]
        m = quality_rules.SMOOTH
        new_good = [(sum(x for x, v in zip(q, rows) if v[j] == 1) + m * quality_rules.RIGHT_GOOD) / (sum(x for x, v in zip(q, rows) if v[j]) + m) for j in range(k)]
        new_bad = [(sum(1 - x for x, v in zip(q, rows) if v[j] == -1) + m * quality_rules.RIGHT_BAD) / (sum(1 - x for x, v in zip(q, rows) if v[j]) + m) for j in range(k)]
        prior = (sum(q) + m * quality_rules.PRIOR) / (len(q) + m)
        good, bad = new_good, new_bad
    return posterior


def test_quality_rules(spark, tmp_path, odd, docs, pairs, empty):
    judged = quality_rules.judge(docs, ["doc_id"]).collect()
    model = em([r.votes for r in judged if not r.base_failed])
    want = {d: brute.quality(t) for d, t in pairs}
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert abs(r.posterior - model(r.votes)) < 1e-9
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    got = quality_rules.op5_quality_rules(spark, table_of(spark, tmp_path, odd)).collect()
    want = {d: brute.quality(t) for d, t in odd_texts()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0


def test_quality_rules_stay_in_the_jvm(docs):
    plan = quality_rules.features(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packing(spark, tmp_path, odd):
    for path, rows in ((SF, None), (table_of(spark, tmp_path, odd), odd_texts())):
        rows = rows or [(r.doc_id, r.text) for r in common.read(spark, path, "documents").collect()]
        ids = dict(zip([d for d, _ in rows], brute.token_ids([t for _, t in rows], tokens.vocabulary_path())))
        got = packing.op2_best_fit_packing(spark, path).collect()
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert by_doc.keys() == ids.keys()
        for d, parts in by_doc.items():
            at = 0
            for k, p in enumerate(sorted(parts, key=lambda p: p.piece)):
                assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == 1024)
                assert p.ids_crc32 == brute.crc(ids[d][at : at + p.length])
                at += p.length
            assert at == len(ids[d]) and len(parts) == -(-at // 1024)
        for parts in by_sequence.values():
            at = 0
            for p in sorted(parts, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 1024
        assert len(by_sequence) <= math.ceil(sum(map(len, ids.values())) / 1024) * 1.03 + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 400)
    a, b = (packing.best_fit(sizes, rng.permutation(400), 1024) for _ in range(2))
    child = packing.crossover(sizes, a, b, 1024, rng)
    assert np.bincount(child, sizes).max() <= 1024 and len(child) == 400
    least = packing.fitness(sizes, packing.best_fit(sizes, np.argsort(-sizes), 1024), 1024)[0]
    assert packing.evolve(sizes, [], 1024, 3)[0].max() + 1 <= least


def test_binary_output(spark, tmp_path, odd):
    for path, rows in ((SF, None), (table_of(spark, tmp_path, odd), odd_texts())):
        rows = sorted(rows or [(r.doc_id, r.text) for r in common.read(spark, path, "documents").collect()])
        ids = brute.token_ids([t for _, t in rows], tokens.vocabulary_path())
        start, want = 0, {}
        for (d, _), x in zip(rows, ids):
            want[d] = start, len(x), brute.crc(x)
            start += len(x)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in binary_output.op9_binary_output(spark, path).collect()} == want


def test_damaged_records_are_noticed():
    import io

    framed = binary_output.record(7, np.array([1, 70000], "<u4").tobytes())
    assert binary_output.unframe(io.BytesIO(framed), 0) == (7, np.array([1, 70000], "<u4").tobytes())
    for at in (0, 9, 14, len(framed) - 1):
        bad = bytearray(framed)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            binary_output.unframe(io.BytesIO(bytes(bad)), 0)


def test_sentencepiece(spark, tmp_path, odd, pairs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    plain = sentencepiece_codec.Codec(sentencepiece_codec.model_path(), dropout=0.0)
    for _, t in pairs[:60]:
        if t and "▁" not in t:
            assert np.frombuffer(plain.encode(t), "<u4").tolist() == sp.encode(t)
    for path in (SF, table_of(spark, tmp_path, odd)):
        got = sentencepiece_codec.op7_sentencepiece(spark, path).collect()
        assert all(r.lossless for r in got)
        again = {r.doc_id: r.ids_crc32 for r in sentencepiece_codec.op7_sentencepiece(spark, path).collect()}
        assert again == {r.doc_id: r.ids_crc32 for r in got}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    text = max((t or "" for _, t in pairs), key=len)
    assert len({codec.encode(text, k) for k in range(4)}) > 1
    there = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, sentencepiece_codec.model_path()), sentencepiece_codec.model_path())
    assert there.where("decoded != coalesce(text, '')").count() == 0 and set(CLASHING) <= set(there.columns)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in common.read(spark, SF, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.op8_embedding_near_dedup(spark, SF).collect()}
    assert got == brute.cosine_links(rows)


def test_odd_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=12)
    rows = [(i, (base + rng.normal(size=12) * s).tolist(), i % 2) for i, s in enumerate([0.02, 0.3, 0.35, 0.4, 0.45, 0.0, 0.0, 0.0] * 12)]
    rows += [(200, None, 0), (201, [0.0] * 12, 0), (202, [1.0, None] + [0.0] * 10, 0), (203, [float("nan")] * 12, 0), (204, base.tolist(), None), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 0), (208, [float("inf")] + [0.0] * 11, 1)]
    df = vectors(spark, rows).withColumn("tile", F.lit(1)).withColumn("n_links", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    want = brute.cosine_links(rows)
    assert {k: v[:2] for k, v in got.items()} == want and all(v[2] == (k == v[1]) for k, v in got.items())
    small = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df, size=5, block=2).collect()}
    assert small == want
    assert embedding_dedup.dedup(vectors(spark, [])).count() == 0


def test_licenses(spark, odd, empty):
    mit = license_scan.TEMPLATES["mit-text"]
    damaged = mit.split()
    del damaged[10:14]
    rows = [(1, f"intro words {mit} and more"), (2, "x " * 5000 + " ".join(damaged)), (3, "nothing of this kind"), (4, None), (5, ""), (6, "Permission is hereby granted"), (1, f"intro words {mit} and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("coverage", F.lit(1))
    got = [(r.doc_id, r.license, round(r.coverage, 3)) for r in license_scan.scan(df).collect()]
    assert sorted(x[:2] for x in got if x[1] == "mit-text") == [(1, "mit-text"), (1, "mit-text"), (2, "mit-text")]
    assert all(x[2] == 1.0 for x in got if x[0] == 1 and x[1] == "mit-text") and not [x for x in got if x[0] > 2]
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(odd).count() == 0


def test_alignment_is_ordered():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def accuracy(spark, rows, label):
    known = common.read(spark, LABELLED, "labels").where(f"{label} is not null").select("doc_id", label)
    return rows.where("held_out").join(known, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("right")).first()


def test_toxicity_on_documents_not_learnt_from(spark, odd, empty):
    rows = toxicity.op1_toxicity(spark, LABELLED).cache()
    r = accuracy(spark, rows, "toxic")
    assert r.n > 500 and r.right > 0.95
    assert rows.where("score < 0 OR score > 1 OR score is null OR predicted != int(score >= 0.3)").count() == 0 and rows.count() == 10000
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(odd, model)
    assert got.count() == len(odd_texts()) and got.where("score is null").count() == 0 and toxicity.score(empty, model).count() == 0


def test_quality_on_documents_not_learnt_from(spark, odd, empty):
    rows = quality_model.op6_quality_classifier(spark, LABELLED).cache()
    r = accuracy(spark, rows, "quality")
    assert r.n > 500 and r.right > 0.9
    assert rows.where("score < 0 OR score > 1 OR score is null OR predicted != int(score >= 0.7)").count() == 0 and rows.count() == 10000
    model = quality_model.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_model.score(odd, model)
    assert got.count() == len(odd_texts()) and got.where("score is null").count() == 0 and quality_model.score(empty, model).count() == 0


def test_held_out_is_one_in_four(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(100).withColumnRenamed("id", "doc_id").select("doc_id", labelled.held_out().alias("h")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in range(100)}


def test_empty_tables(spark, tmp_path, empty):
    path = table_of(spark, tmp_path, empty)
    for op in (substring_dedup.op3_substring_dedup, jaccard_join.op4_ngram_jaccard_join, packing.op2_best_fit_packing, binary_output.op9_binary_output, sentencepiece_codec.op7_sentencepiece):
        assert op(spark, path).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(120)] + [(500 + rng.randint(0, 40), 500 + rng.randint(0, 40)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == brute.roots({x for p in links for x in p}, links)


def test_components_end_with_stars(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rounds, whole = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a: rounds.append(1) or whole(self, *a))
    links = [(1, i) for i in range(2, 9)] + [(20, 21)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == brute.roots({x for p in links for x in p}, links)
    assert len(rounds) == 2  # the edges, and a round that leaves stars
