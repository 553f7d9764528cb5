"""The pipeline's stages, each against a plain version on what the stage before it kept."""

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import common, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = common.saved(stage(spark, docs, SF), name)
        if name != "pack":
            assert docs.columns == columns
            kept[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.select("doc_id", "text", "n_chars").collect()]
        if name == "quality":
            bad = {d for d, t in before if (q := brute.quality(t))[0] < 50 or 100 * q[4] > 50 * q[0]}
            assert not bad & {d for d, *_ in kept[name]}
            assert len(kept[name]) > 0.6 * (len(before) - len(bad))
        if name == "near_duplicates":
            want = {d for d, (_, c) in brute.jaccard(before).items() if d == c}
            assert {d for d, *_ in kept[name]} == want
        if name == "substrings":
            import hashlib

            want = brute.substring(before)
            assert len(kept[name]) == len(before) and all(n == len(t) for _, t, n in kept[name])
            for d, t, _ in kept[name]:
                assert hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest() == want[d][2]
        if name == "pack":
            ids = dict(zip([d for d, _ in before], brute.token_ids([t for _, t in before], tokens.vocabulary_path())))
            total = {}
            for r in docs.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {d: len(x) for d, x in ids.items()}
    assert len(kept["toxicity"]) < 200


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
