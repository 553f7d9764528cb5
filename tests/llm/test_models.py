"""The models' arithmetic against plain versions, and what they do without labels."""

import numpy as np
import pyarrow as pa

from tidewatch.llm import quality_model, toxicity


def _texts():
    texts = ["One two three. " * 30, "", "!!! ### $$$", "a b c d e f g " * 40 + "\nlast"]
    parts = list(quality_model.encode(pa.array(texts)))
    row = np.concatenate([p[0] + p[2] for p in parts])
    return row, *[np.concatenate([p[k] for p in parts]) for k in (3, 4, 5)], len(texts)


def test_gradient_by_finite_differences():
    row, x, n, word, docs = _texts()
    rng = np.random.default_rng(1)
    model = quality_model.train([(1, (x[row == 0], n[row == 0], word[: n[row == 0].sum()]))])
    for k in model.w:
        if k != "spread":
            model.w[k] = np.asarray(rng.normal(0, 0.5, model.w[k].shape))
    y = np.array([1.0, 0, 0, 1])

    def loss():
        z = model.forward(x, n, word, row, docs)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad = model.gradient(x, n, word, row, y)
    hit, own = grad.pop("word")
    grad["word"] = np.zeros_like(model.w["word"])
    grad["word"][hit] = own
    for k, g in grad.items():
        where = [(int(hit[j]), j) for j in range(3)] if k == "word" else list(np.ndindex(np.shape(g)))[:6]
        for at in where:
            w, old = model.w[k], float(model.w[k][at])
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - np.asarray(g)[at]) < 1e-6, (k, at)


def test_forward_passage_by_passage():
    row, x, n, word, docs = _texts()
    rng = np.random.default_rng(2)
    model = quality_model.train([])
    for k in model.w:
        if k != "spread":
            model.w[k] = np.asarray(rng.normal(0, 0.5, model.w[k].shape))
    w = model.w
    z, attention, _ = model.forward(x, n, word, row, docs)
    begin = np.cumsum(n) - n
    for doc in range(docs):
        codes, weights = [], []
        for p in np.flatnonzero(row == doc):
            mean = w["word"][word[begin[p] : begin[p] + n[p]]].mean(0) if n[p] else 0
            code = np.tanh(np.clip((x[p] - w["mean"]) / w["spread"], -6, 6) @ w["code"] + w["code_bias"] + mean)
            codes.append(code)
            weights.append(np.exp((np.tanh(code @ w["tanh"]) / (1 + np.exp(-(code @ w["gate"])))) @ w["attend"]))
        weights = np.array(weights) / np.sum(weights)
        assert np.allclose(attention[row == doc], weights)
        assert np.isclose(z[doc], weights @ np.array(codes) @ w["out"] + w["out_bias"])


def test_without_labels_of_both_kinds_nothing_is_toxic():
    for rows in ([], [(0, [["a", "b"]])] * 20):
        model = toxicity.train(rows)
        assert model.probability(model.worst("a b c")) < toxicity.THRESHOLD
        assert model.probability(model.worst("")) < toxicity.THRESHOLD


def test_misspelt_words_share_subwords():
    clean = [(0, [["quiet", "green", "river", f"stone{i}"]]) for i in range(60)]
    model = toxicity.train(clean + [(1, [["quiet", "dreadfool", "river", f"stone{i}"], ["green", "stone"]]) for i in range(60)])
    assert model.worst("quiet dreadfooool river") > model.worst("quiet green river")
    assert model.probability(model.worst("quiet dreadfool river")) > 0.5 > model.probability(model.worst("quiet green river"))
