"""Toxicity: subword bags averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself), a passage the mean of its
words (a repeated one counts once, so that a word said over and over is no worse), and a linear softmax
tells toxic passages from others; vectors and softmax are trained together in numpy, at first on all
passages with their documents' labels, then on the worst passage alone of each toxic document. A misspelling that was never seen still shares n-grams with what was. A document is as toxic
as its worst passage, so a long text does not dilute an insult; how that passage's score maps to a
probability is fitted on labelled documents that the vectors were not trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common, labelled

WORD = re.compile(r"[^\W_]+")
#: Words in a passage.
PASSAGE = 8
NGRAMS = (3, 4, 5)
BUCKETS, WIDTH = 1 << 16, 8
STEPS, BATCH, RATE = 1500, 256, 0.1
#: Share of the rounds in which each passage has its document's label.
SOME_ROUNDS = 0.4
#: Labelled documents that are learnt from, with their whole texts.
TRAIN_DOCS = 4000
#: A score from which a document counts as toxic.
THRESHOLD = 0.3
#: Scored words that a Python worker remembers.
REMEMBERED = 400_000


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    marked = f"<{word}>"
    if marked.isascii():  # slices of bytes are n-grams of characters then
        marked = marked.encode()
        found = [marked, *[marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]]
    else:
        found = [marked.encode(), *[marked[i : i + n].encode() for n in NGRAMS for i in range(len(marked) - n + 1)]]
    return [zlib.crc32(x) % BUCKETS for x in dict.fromkeys(found)]


def passages(text: str | None) -> list[list[str]]:
    """The words of a text, PASSAGE at a time."""
    words = WORD.findall((text or "").lower())
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]


class Model:
    """Subword scores (the vectors times the softmax's difference), its bias, and the map to a document's probability."""

    def __init__(self, scores: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.scores, self.bias, self.slope, self.shift = scores, bias, slope, shift
        self.listed = scores.tolist()
        self.known: dict[str, float] = {}

    def worst(self, text: str | None) -> float:
        """The log odds of a text's worst passage; the bias alone for a text without words."""
        words = WORD.findall((text or "").lower())
        if not words:
            return self.bias
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in {*words}.difference(known):
            own = [self.listed[i] for i in subwords(w)]
            known[w] = sum(own) / len(own)
        parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
        return max(sum([known[w] for w in dict.fromkeys(part)]) / len(part) for part in parts) + self.bias

    def probability(self, worst: float) -> float:
        """The probability that a document with this worst passage is labelled toxic."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -50, 50))))


def train(rows: Iterable[tuple[int, list[list[str]]]], seed: int = 0, shift: float = 0.0) -> Model:
    """A model from (label, passages) of documents.

    Where there are no documents or all have one label, every text scores the share of toxic ones among
    them and nine clean ones more, so nothing is called toxic for want of labels. ``shift`` is added to the log odds of a document, for rows that have not the labels' own shares.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    held, doc_labels = [], []
    for label, parts in rows:  # taken one by one, so texts need not be held together
        doc_labels.append(label)
        own = [dict.fromkeys(part) for part in parts]
        held.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for part in own for w in part], np.int32), np.array([len(part) for part in own], np.int32), np.array([len(part) for part in parts], np.int32)))
    doc_labels = np.array(doc_labels, np.int64)
    if not vocabulary or len({*doc_labels.tolist()}) < 2:
        toxic = int(doc_labels.sum())
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log((toxic + 1) / (len(doc_labels) - toxic + 9))))
    # of each passage its distinct words (within ``words``), its length, its document and that one's label
    words, distinct, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
    of = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    del held
    words_at = np.cumsum(distinct) - distinct
    labels = doc_labels[of].astype(np.float32)
    later = of % 5 == 0  # for the calibration
    learnt = np.flatnonzero(~later)
    if len(learnt) == 0:
        learnt = np.arange(len(of))
    parts_of = [np.array(subwords(w), np.int32) for w in vocabulary]
    n_parts = np.array([len(p) for p in parts_of])
    flat, begin = np.concatenate(parts_of), np.cumsum(n_parts) - n_parts
    del parts_of, vocabulary

    def worst_passages() -> tuple[np.ndarray, np.ndarray]:
        """The score of each passage, and of each document's worst one."""
        each = np.add.reduceat((vectors @ (softmax[:, 1] - softmax[:, 0]))[flat], begin) / n_parts
        mean = np.add.reduceat(each[words], words_at) / sizes
        worst = np.full(len(doc_labels), -np.inf)
        np.maximum.at(worst, of, mean)
        return mean, worst

    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([1 - labels[learnt].mean() + 1e-6, labels[learnt].mean() + 1e-6], np.float32))
    seen = [np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6, np.float32)]
    rounds = -(-STEPS * BATCH // max(len(learnt), BATCH))
    told = learnt
    for turn in range(rounds):
        if turn >= rounds * SOME_ROUNDS:
            # what a toxic document's label tells about is its worst passage; the others' labels are not known
            mean, worst = worst_passages()
            told = learnt[(labels[learnt] == 0) | (mean[learnt] >= worst[of[learnt]])]
        order = rng.permutation(told)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            size, y, n = sizes[own], labels[own], distinct[own]
            ids, which = np.unique(words[_ranges(words_at[own], n)], return_inverse=True)
            first = np.cumsum(n) - n
            take = _ranges(begin[ids], n_parts[ids])
            parts, part_first = flat[take], np.cumsum(n_parts[ids]) - n_parts[ids]
            word = np.add.reduceat(vectors[parts], part_first) / n_parts[ids][:, None]
            mean = np.add.reduceat(word[which], first) / size[:, None]
            z = mean @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y.astype(int)] -= 1
            g_softmax = mean.T @ p / len(y)
            g_each = np.repeat(p @ softmax.T / size[:, None], n, 0)
            g_word = np.stack([np.bincount(which, g_each[:, k], len(ids)) for k in range(WIDTH)], 1)
            g_part = np.repeat(g_word / n_parts[ids][:, None], n_parts[ids], 0)
            hit, back = np.unique(parts, return_inverse=True)
            g = np.stack([np.bincount(back, g_part[:, k], len(hit)) for k in range(WIDTH)], 1).astype(np.float32)
            seen[0][hit] += (g * g).mean(1)
            vectors[hit] -= RATE * g / np.sqrt(seen[0][hit])[:, None]
            seen[1] += g_softmax**2
            softmax -= RATE * g_softmax / np.sqrt(seen[1])
    model = Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))
    worst = worst_passages()[1] + model.bias
    worst[np.isinf(worst)] = model.bias  # texts without words
    own = np.arange(len(worst)) % 5 == 0
    model.slope, model.shift = calibrated(worst[own], doc_labels[own])
    model.shift += shift
    return model


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through scores and labels, by Newton steps on smoothed labels."""
    if len({*y.tolist()}) < 2:
        return 1.0, 0.0
    scale = float(x.std()) or 1.0
    design = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w += np.clip(np.linalg.solve(h, design.T @ (target - p) - 1e-3 * w), -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""

    def some(text: str | None) -> bytes:
        return zlib.compress(" ".join(WORD.findall((text or "").lower())).encode(), 1)

    rows, shift = labelled.sample(docs, labels, "toxic", TRAIN_DOCS, some)
    model = train(((y, passages(zlib.decompress(raw).decode())) for y, raw in rows), shift=shift)
    common.swept(docs.sparkSession)  # what the training held
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1), from whole texts; one row for each row.

    Null, empty and wordless texts get the score of a passage without words. Repeated rows get equal
    scores, empty tables give no rows, a column named score is replaced and others are kept.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast((model.scores, model.bias, model.slope, model.shift))
    names = [c for c in docs.columns if c != "score"]
    place = names.index("text")

    def rate(batches):
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.probability(own.worst(text)) for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(names).mapInArrow(common.released(rate), ", ".join(f"`{c}` {fields[c]}" for c in names) + ", score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return rated.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
