"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams and of itself, so
a spelling that was never seen shares most of its vectors with those that were.  The
words of a segment of a text are averaged (with a few neutral words mixed in, for
short segments) and a linear softmax gives the chance that the segment is toxic; the
text's score is that of its worst segment, so a remark is not diluted by the length
of its text.  Embeddings and softmax are trained jointly in numpy: first each text as
one bag, then each clean segment as clean and the worst segment of a toxic text as
toxic.  At scoring time a word is one number, and a text is read whole in one pass.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Rows, WordMemo, bounded_sample, fields, give_back, keep_rows, kept, over_texts, sums, with_results, word_ngrams

SIZES, BUCKETS, WIDTH = (3, 4, 5), 1 << 17, 4
SEGMENT, NEUTRAL = 40, 4
SAMPLE_ROWS = 1000          # labelled rows of each label to fit on
SAMPLE_CHARS = 60_000       # longer texts are not used to fit


@dataclass
class Model:
    grams: np.ndarray       # each bucket's part of the margin
    bias: float
    key: str


def _bags(split: list[list[bytes]], segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each segment, text of each segment); texts without words have none."""
    first, of, done = [], [], 0
    for i, x in enumerate(split):
        k = max(1, (len(x) + segment // 2) // segment) if x else 0
        first.extend(done + (len(x) * j) // k for j in range(k))
        of.extend([i] * k)
        done += len(x)
    return np.array(first, np.int64), np.array(of, np.int64)


class _Trainer:
    """Accelerated full-batch steps on embeddings (buckets x width) and softmax weights (width x 2).

    Embeddings start at zero, so n-grams that were not seen say nothing, and each is
    scaled by its share of the sample, with a floor that keeps rare ones from being learned by heart.
    """

    FLOOR = 1e-5

    def __init__(self, words: list[bytes], text: np.ndarray, first: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.text = text
        self.grams, self.start = word_ngrams(words, SIZES, BUCKETS, True)
        self.many = np.diff(np.append(self.start, len(self.grams)))
        self.used, self.at = np.unique(self.grams, return_inverse=True)
        self.e = np.zeros((len(self.used), WIDTH), np.float32)
        self.w = r.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.scale = np.ones(len(self.used), np.float32)
        share = self.back(np.full((len(first), 1), 1 / len(first), np.float32), first)[:, 0]
        self.scale = (1 / np.sqrt(share + self.FLOOR)).astype(np.float32)

    def bags(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        v = np.add.reduceat((e * self.scale[:, None])[self.at], self.start, axis=0) / self.many[:, None].astype(np.float32)
        n = np.diff(np.append(first, len(self.text))) + NEUTRAL
        return np.add.reduceat(v[self.text], first, axis=0) / n[:, None].astype(np.float32)

    def back(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The gradient of the embeddings, given that of the bags."""
        n = np.diff(np.append(first, len(self.text)))
        p = p / (n + NEUTRAL)[:, None]
        out = np.empty((len(self.used), p.shape[1]), np.float32)
        for k in range(p.shape[1]):
            word = np.bincount(self.text, np.repeat(p[:, k], n), len(self.many)) / self.many
            out[:, k] = np.bincount(self.at, np.repeat(word, self.many), len(self.used))
        return out * self.scale[:, None]

    def margins(self, first: np.ndarray) -> np.ndarray:
        return self.bags(self.e, first) @ (self.w[:, 1] - self.w[:, 0]) + self.b[1] - self.b[0]

    def go(self, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> None:
        """``weight`` sums to one; bags of weight zero take no part."""
        weight = weight[:, None].astype(np.float32)
        v = np.ones((len(self.used), 1), np.float32)
        for _ in range(4):
            v = self.back(weight * self.bags(v, first), first)
            top = float(np.linalg.norm(v))
            v /= top + 1e-30
        last = self.e
        for t in range(rounds):
            z = self.e + np.float32(t / (t + 3.0)) * (self.e - last)
            bag = self.bags(z, first)
            g = bag @ self.w + self.b
            g -= g.max(1, keepdims=True)
            p = np.exp(g)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight
            d = self.back(p @ self.w.T, first)
            rate = 1 / (top * float(np.square(self.w).sum()) / 2 + 1e-12)
            last, self.e = self.e, z - np.float32(rate) * d
            self.w -= np.float32(0.05) * (bag.T @ p)
            self.b -= p.sum(0)


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, seed: int = 5) -> Model:
    """A model from up to ``rows`` documents of each label (0 and 1, of least hash of their id).

    Documents with another or no label, without text, or of over SAMPLE_CHARS characters
    are not used; with one label only, the model gives that label everywhere.  Ids are
    matched with labels without their texts; the texts of those chosen are then fetched.
    """
    give_back()
    told = labels.select(F.col(doc).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    fit_ = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(doc).alias("doc_id"))
    chosen = bounded_sample(fit_.join(told, "doc_id"), "label", rows, [F.col("doc_id")], seed)
    ids = docs.sparkSession.createDataFrame(chosen.toArrow())     # 2 x rows ids at most
    found = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids.distinct()), "doc_id").filter(F.length("text") <= SAMPLE_CHARS)
    got = sorted((r.label, r.text) for r in found.collect())
    y = np.array([v for v, _ in got], np.int64)
    split = [t.encode().lower().split() for _, t in got]
    del got
    have = np.array([bool(x) for x in split], bool)
    split, y = [x for x in split if x], y[have]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 5.0 if len(y) and y[0] else -5.0, uuid.uuid4().hex)
    index: dict = {}
    words = np.fromiter((index.setdefault(w, len(index)) for x in split for w in x), np.int64)
    split = [range(len(x)) for x in split]          # from here on only the sizes count
    first = np.cumsum([0] + [len(x) for x in split[:-1]])
    t = _Trainer(list(index), words, first, seed)
    t.go(first, y, np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()), 32)
    seg, of = _bags(split, SEGMENT)
    for _ in range(2):
        m, worst = t.margins(seg), np.full(len(y), -np.inf)
        np.maximum.at(worst, of, m)
        bad, good = (y[of] == 1) & (m == worst[of]), y[of] == 0
        t.go(seg, y[of], np.where(bad, 0.5 / max(bad.sum(), 1), np.where(good, 0.5 / max(good.sum(), 1), 0.0)), 10)
    # the bias at which the texts of the sample are split best, each at its worst segment
    m = t.margins(seg)
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, of, m)
    order = np.argsort(worst, kind="stable")
    wrong = np.concatenate([[0.0], np.cumsum(np.where(y[order] == 1, 1.0, -8.0))]) + 8.0 * (y == 0).sum()
    at = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[worst.min() - 1], worst[order], [worst.max() + 1]])
    mid = at[len(at) // 2]
    move = float((edge[mid] + edge[mid + 1]) / 2)
    grams = np.zeros(BUCKETS, np.float32)
    grams[t.used] = t.scale * (t.e @ (t.w[:, 1] - t.w[:, 0]))
    return Model(grams, float(t.b[1] - t.b[0]) - move, uuid.uuid4().hex)


class _Scorer:
    def __init__(self, m: Model):
        self.m, self.margin = m, Rows()
        self.memo = WordMemo(self.learn, self.margin.keep, 200_000)

    def learn(self, words):
        grams, first = word_ngrams(words, SIZES, BUCKETS, True)
        self.margin.add(sums(self.m.grams[grams], first) / np.diff(np.append(first, len(grams))))

    def __call__(self, texts):
        split = [(t or b"").lower().split() for t in texts]
        at = self.memo.rows([w for x in split for w in x])
        worst = np.full(len(texts), -np.inf)
        seg, of = _bags(split, SEGMENT)
        if len(seg):
            n = np.diff(np.append(seg, len(at)))
            np.maximum.at(worst, of, sums(self.margin.data[at], seg) / (n + NEUTRAL))
        z = np.clip(np.where(np.isinf(worst), 0.0, worst) + self.m.bias, -60, 60)
        return 1 / (1 + np.exp(-z))


def _scorer(shared):
    return lambda: kept(("toxicity", shared.value.key), lambda: _Scorer(shared.value))


def score(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with score (0 to 1) and predicted (1 from 0.5 on).

    Texts that are null or have no words get the score of an empty bag, from the bias alone.
    """
    results = {"score": "double", "predicted": "int"}
    begin = _scorer(docs.sparkSession.sparkContext.broadcast(m))

    def start():
        f = begin()

        def of(rows, texts):
            s = f(texts)
            return with_results(rows, {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}, (text,))
        return of
    return over_texts(docs, fields(docs, results, (text,)), start, text)


def keep_clean(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """The rows that are scored below 0.5; columns unchanged."""
    begin = _scorer(docs.sparkSession.sparkContext.broadcast(m))

    def start():
        f = begin()
        return lambda rows, texts: f(texts) < 0.5
    return keep_rows(docs, start, text)
