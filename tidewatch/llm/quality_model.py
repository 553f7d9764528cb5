"""Quality classifier: attention-based multiple-instance learning.

Every passage of a text is encoded by a small network from the mean of its words' vectors and from counts
over their letters; gated attention, learnt with the vectors from labels of whole documents, weighs the
passages, and a logistic unit scores the weighted sum of their codes. So a few bad passages can decide
about a long document, and which ones did can be read off the weights. Words share vectors by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, labelled

#: Words in a passage.
PASSAGE = 64
CODE, GATE = 16, 8
#: Vectors that words share.
BUCKETS = 1 << 14
STEPS, BATCH, RATE, WORD_RATE, DECAY = 900, 64, 0.02, 0.02, 1e-4
#: Labelled documents that are learnt from, with their whole texts.
TRAIN_DOCS = 4000
#: A score from which a document counts as good.
THRESHOLD = 0.7
FEATURES = 12

_CLASSES = [b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".", b"!?", b",;:", b"\n", bytes(range(128, 256))]
_MARKS = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES):
    _MARKS[_i, list(_c)] = True


def encode(column: pa.Array):
    """For runs of texts: (first row, number of texts, row, features and number of words of each passage, bucket of each word).

    Each text has a passage at least; one without words has all features 0.
    """
    for first, offsets, data in common.slices(column):
        docs = len(offsets) - 1
        doc, start, end, h = common.words(offsets, data)
        count = np.bincount(doc, minlength=docs)
        place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        begin = np.flatnonzero(place % PASSAGE == 0)
        row = doc[begin]
        bare = np.flatnonzero(count == 0)
        out = np.zeros((len(begin) + len(bare), FEATURES), np.float32)
        n = np.zeros(0, np.int64)
        if len(begin):
            n = np.diff(np.r_[begin, len(doc)])
            length = np.add.reduceat(end - start, begin)
            edge = np.r_[start[begin], len(data)]
            for k in range(len(_CLASSES)):
                total = np.r_[0, np.cumsum(_MARKS[k][data], dtype=np.int32)]
                out[: len(begin), k] = (total[edge[1:]] - total[edge[:-1]]) / n
            out[: len(begin), 8] = length / n / 8
            # words of runs of three that the text has elsewhere, too
            again = np.zeros(len(doc) + 2)
            runs = common.grams(h, 3)
            if len(runs):
                key = common.mix(runs + doc[: len(runs)].astype(np.uint64))
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                same &= doc[: len(runs)][order][1:] == doc[: len(runs)][order][:-1]
                twice = np.zeros(len(runs), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice &= doc[: len(runs)] == doc[2:]
                again[: len(runs)] += twice
            covered = (np.convolve(again[: len(doc)], [1, 1, 1])[: len(doc)] > 0).astype(np.float32)
            out[: len(begin), 9] = np.add.reduceat(covered, begin) / n
            out[: len(begin), 10] = n / PASSAGE
            out[: len(begin), 11] = np.log1p(np.add.reduceat(((end - start) == 1).astype(np.float32), begin) / n)
        row, n = np.r_[row, bare], np.r_[n, np.zeros(len(bare), np.int64)]
        order = np.argsort(row, kind="stable")  # passages with words stay in order, as their words do
        yield first, docs, row[order], out[order], n[order], (h % np.uint64(BUCKETS)).astype(np.uint16)



class Model:
    """Weights by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, x: np.ndarray, n: np.ndarray, word: np.ndarray, row: np.ndarray, docs: int):
        """(log odds of each document, attention of each passage, and what the gradient needs)."""
        w = self.w
        x = np.clip((x - w["mean"]) / w["spread"], -6, 6)
        code = x @ w["code"] + w["code_bias"]
        some = np.flatnonzero(n)
        if len(some):
            code[some] += np.add.reduceat(w["word"][word], (np.cumsum(n) - n)[some]) / n[some, None]
        code = np.tanh(code)
        t, g = np.tanh(code @ w["tanh"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        a = (t * g) @ w["attend"]
        begin = np.searchsorted(row, np.arange(docs))
        a = np.exp(a - np.maximum.reduceat(a, begin)[row])
        a /= np.add.reduceat(a, begin)[row]
        pooled = np.add.reduceat(code * a[:, None], begin)
        return pooled @ w["out"] + w["out_bias"], a, (x, code, t, g, pooled, begin)

    def gradient(self, x, n, word, row, y) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over documents with labels y, by each weight; for words (buckets, their rows)."""
        w = self.w
        z, a, (xs, code, t, g, pooled, begin) = self.forward(x, n, word, row, len(y))
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        d_pooled = d[:, None] * w["out"]
        d_code = a[:, None] * d_pooled[row]
        d_a = (code * d_pooled[row]).sum(1)
        d_a = a * (d_a - np.add.reduceat(a * d_a, begin)[row])
        d_tg = d_a[:, None] * w["attend"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_code += d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_code *= 1 - code * code
        hit, which = np.unique(word, return_inverse=True)
        passage = np.repeat(np.arange(len(n)), n)
        each = d_code / np.maximum(n, 1)[:, None]
        d_word = np.stack([np.bincount(which, each[passage, k], len(hit)) for k in range(CODE)], 1)
        return {"out": pooled.T @ d, "out_bias": d.sum(), "attend": (t * g).T @ d_a, "tanh": code.T @ d_t, "gate": code.T @ d_g, "code": xs.T @ d_code, "code_bias": d_code.sum(0), "word": (hit, d_word)}


def train(rows: list[tuple[int, tuple]], seed: int = 0, shift: float = 0.0) -> Model:
    """A model from (label, (features, words of each passage, bucket of each word)) of documents.

    No documents give one that scores everything alike. ``shift`` is added to the log odds, for rows that
    have not the labels' own shares.
    """
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"mean": np.zeros(FEATURES), "spread": np.ones(FEATURES), "word": np.zeros((BUCKETS, CODE), np.float32), "code": draw(FEATURES, CODE), "code_bias": np.zeros(CODE), "tanh": draw(CODE, GATE), "gate": draw(CODE, GATE), "attend": draw(GATE), "out": np.zeros(CODE), "out_bias": np.zeros(())}
    model = Model(w)
    if not rows:
        return model
    y = np.array([r[0] for r in rows], float)
    every = np.concatenate([r[1][0] for r in rows]).astype(float)
    w["mean"], w["spread"] = every.mean(0), every.std(0) + 1e-3
    w["out_bias"] = np.array(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    learnt = [k for k in w if k not in ("mean", "spread", "word")]
    first, second = ({k: np.zeros_like(w[k]) for k in learnt} for _ in range(2))
    seen, order = np.full(BUCKETS, 1e-8, np.float32), np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.r_[order, rng.permutation(len(rows))]
        own, order = order[:BATCH], order[BATCH:]
        x, n, word = (np.concatenate([rows[i][1][k] for i in own]) for k in range(3))
        row = np.repeat(np.arange(len(own)), [len(rows[i][1][0]) for i in own])
        grad = model.gradient(x, n, word, row, y[own])
        hit, g = grad["word"]
        seen[hit] += (g * g).mean(1)
        w["word"][hit] -= (WORD_RATE * g / np.sqrt(seen[hit])[:, None]).astype(np.float32)
        for k in learnt:
            gk = grad[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * gk
            second[k] = 0.999 * second[k] + 0.001 * gk * gk
            rate = RATE * (1 - (step - 1) / STEPS)
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w["out_bias"] = w["out_bias"] + shift
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""

    def some(text: str | None) -> tuple:
        parts = list(encode(pa.array([text or ""])))
        return tuple(np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))

    rows, shift = labelled.sample(docs, labels, "quality", TRAIN_DOCS, some)
    return train(rows, shift=shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and the place of the passage that weighs most.

    Null, empty and wordless texts are one passage without words. Repeated rows get equal scores, empty
    tables give no rows; columns named score and top_passage are replaced, others are kept.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model.w)
    names = [c for c in docs.columns if c not in ("score", "top_passage")]
    place = names.index("text")

    def rate(batches):
        own = Model(shared.value)
        for batch in batches:
            scores, tops = [], []
            for _, docs_in, row, x, n, word in encode(batch.column(place)):
                z, a, (*_, begin) = own.forward(x, n, word, row, docs_in)
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                order = np.lexsort((-a, row))
                tops.append(order[begin] - begin)
            both = [np.concatenate(v) if v else np.zeros(0) for v in (scores, tops)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[0], pa.float64()), pa.array(both[1].astype(np.int64), pa.int64())], [*names, "score", "top_passage"])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(names).mapInArrow(common.released(rate), ", ".join(f"`{c}` {fields[c]}" for c in names) + ", score double, top_passage long")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return rated.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
