"""Language identification in two steps: the family first, then the language within it.

A text's features are shares of hashed character n-grams of its words.  A linear
support vector machine for each family (one against the rest) chooses the family;
within a family of several languages a machine for each pair votes, and the sum of
margins settles equal votes.  All machines are fitted in numpy on a bounded sample of
labelled rows; every one of them is linear in the n-gram shares, so a text is scored
by adding up its words' margins, whole, in one pass.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Rows, WordMemo, bounded_sample, fields, give_back, keep_rows, kept, over_texts, sums, with_results, word_ngrams

# Families of common language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl af sv da no nb nn is", "romance": "fr es pt it ca ro gl oc", "slavic": "ru uk be bg sr hr bs sl mk pl cs sk",
    "uralic": "fi et hu", "turkic": "tr az kk uz", "indic": "hi ur bn mr ne", "semitic": "ar he", "sinitic": "zh yue",
}
SIZES, BUCKETS = (1, 2, 3), 1 << 13
SAMPLE_ROWS = 4000          # labelled rows to fit on, over all languages
SAMPLE_CHARS = 100_000      # longer texts are not used to fit


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), code)


@dataclass
class Model:
    langs: list[str]
    groups: list[list[int]]         # languages of each family
    pairs: list[tuple[int, int]]    # machines within families: positive and negative language
    weights: np.ndarray             # buckets x (families + pairs)
    bias: np.ndarray
    key: str


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps, classes of equal weight."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (share.astype(np.float32) * (x @ v))
        v /= np.linalg.norm(v) + 1e-30
    top = float(np.linalg.norm(x.T @ (share.astype(np.float32) * (x @ v)))) + 1.0
    w = last = np.zeros(x.shape[1], np.float32)
    b = last_b = 0.0
    for t in range(rounds):
        m = t / (t + 3.0)
        z, zb = w + m * (w - last), b + m * (b - last_b)
        slack = np.maximum(0, 1 - y * (x @ z + zb)) * share
        g = -2 * (x.T @ (y * slack).astype(np.float32)) + ridge * z
        last, last_b = w, b
        w, b = (z - g / (2 * top)).astype(np.float32), float(zb + 2 * (y * slack).sum() / (2 * top))
    return w, b


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, seed: int = 3) -> Model | None:
    """A model from up to ``rows`` rows of ``docs`` (an equal bound for each language, of least hash).

    Rows without text or language, and texts of over SAMPLE_CHARS characters, are not
    used; None if nothing is left.
    """
    give_back()
    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc).alias("doc_id")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (F.length("text") <= SAMPLE_CHARS))
    n = usable.select("lang").distinct().count()
    if not n:
        return None
    some = bounded_sample(usable, "lang", max(20, rows // n), [F.col("doc_id"), F.col("text")], seed)

    def start():
        def count(b, texts):
            at, share = [], []
            for t in texts:
                grams, _ = word_ngrams(t.lower().split(), SIZES, BUCKETS, False)
                k, c = np.unique(grams, return_counts=True)
                at.append(k.astype(np.int32)), share.append((c / len(grams)).astype(np.float32))
            return pa.RecordBatch.from_arrays([b.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                                              names=["lang", "at", "share"])
        return count
    got = over_texts(some.select("lang", "text"), "lang string, at array<int>, share array<float>", start).toArrow()
    lang_of, lists = got.column("lang").to_pylist(), got.column("at").combine_chunks()
    ends, at, share = lists.offsets.to_numpy(), lists.values.to_numpy(), got.column("share").combine_chunks().values.to_numpy()
    langs = sorted(set(lang_of))
    x = np.zeros((len(lang_of), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        x[i, at[a:b]] = share[a:b]
    del got, lists, at, share
    scale = 1 / np.sqrt(x.mean(0) + 1e-5).astype(np.float32)
    x *= scale
    x = x[(order := np.lexsort([x.sum(1), np.array(lang_of)]))]
    of = np.array([langs.index(v) for v in lang_of])[order]
    names = sorted({family(v) for v in langs})
    groups = [[i for i, v in enumerate(langs) if family(v) == f] for f in names]
    pairs = [p for g in groups for p in itertools.combinations(g, 2)]
    w, b = [], []
    for g in groups:
        y = np.where(np.isin(of, g), 1.0, -1.0)
        one = (np.zeros(BUCKETS, np.float32), 1.0) if len(groups) == 1 else _machine(x, y)
        w.append(one[0]), b.append(one[1])
    for p, q in pairs:
        use = (of == p) | (of == q)
        one = _machine(x[use], np.where(of[use] == p, 1.0, -1.0))
        w.append(one[0]), b.append(one[1])
    return Model(langs, groups, pairs, (np.array(w, np.float32) * scale).T.copy(), np.array(b), uuid.uuid4().hex)


def decide(m: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of rows of margins; equal margins go to the first family and language by name."""
    fam = margins[:, : len(m.groups)]
    chosen = fam.argmax(1)
    e = np.exp(3 * (fam - fam.max(1, keepdims=True)))
    score = e[np.arange(len(e)), chosen] / e.sum(1)
    lang = np.array([g[0] for g in m.groups])[chosen]
    for f, g in enumerate(m.groups):
        at = np.flatnonzero(chosen == f)
        if len(g) < 2 or not len(at):
            continue
        votes, total = np.zeros((len(at), len(g))), np.zeros((len(at), len(g)))
        for j, (p, q) in enumerate(m.pairs):
            if p in g:
                d = margins[at, len(m.groups) + j]
                for who, z in ((g.index(p), d), (g.index(q), -d)):
                    votes[:, who] += (z > 0) + 0.5 * (z == 0)
                    total[:, who] += z
        best = (votes + 1e-3 * np.tanh(total / len(g))).argmax(1)
        lang[at] = np.array(g)[best]
        score[at] *= 1 / (1 + np.exp(-3 * total[np.arange(len(at)), best] / (len(g) - 1)))
    return lang, np.clip(score, 0, 1)


class _Scorer:
    def __init__(self, m: Model):
        self.m, self.margin, self.size = m, Rows((m.weights.shape[1],)), Rows()
        self.memo = WordMemo(self.learn, lambda rows: (self.margin.keep(rows), self.size.keep(rows)), 200_000)

    def learn(self, words):
        for lo in range(0, len(words), 10_000):         # a row of weights an n-gram is held at once
            grams, first = word_ngrams(words[lo: lo + 10_000], SIZES, BUCKETS, False)
            self.margin.add(sums(self.m.weights[grams], first))
            self.size.add(np.diff(np.append(first, len(grams))))

    def __call__(self, texts):
        split = [(t or b"").lower().split() for t in texts]
        at = self.memo.rows([w for x in split for w in x])
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        first = ends - np.array([len(x) for x in split], np.int64)
        total = sums(self.margin.data[at], first)
        size = sums(self.size.data[at], first)
        return decide(self.m, total / np.maximum(size, 1)[:, None] + self.m.bias)


def _marker(shared, text: str):
    def start():
        m = shared.value
        scorer = kept(("language", m.key), lambda: _Scorer(m)) if m else None

        def mark(rows, texts):
            pred, s = np.full(len(texts), "und", object), np.zeros(len(texts))
            if scorer:
                at, s = scorer(texts)
                pred = np.array(m.langs, object)[at]
            letters = pc.fill_null(pc.match_substring_regex(rows.column(text), r"\pL"), False).to_numpy(zero_copy_only=False)
            return np.where(letters, pred, "und"), np.where(letters, s, 0.0)
        return mark
    return start


def predict(docs: DataFrame, m: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with lang_pred and score (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if there is no model.
    """
    results = {"lang_pred": "string", "score": "double"}
    marker = _marker(docs.sparkSession.sparkContext.broadcast(m), text)

    def start():
        mark = marker()

        def score(rows, texts):
            pred, s = mark(rows, texts)
            return with_results(rows, {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(s)}, (text,))
        return score
    return over_texts(docs, fields(docs, results, (text,)), start, text)


def keep_identified(docs: DataFrame, m: Model | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose language is told: not ``und`` and, given a model, scored at ``least`` or more; columns unchanged."""
    if m is None:
        return docs.filter(F.col(text).rlike("\\p{L}"))
    marker = _marker(docs.sparkSession.sparkContext.broadcast(m), text)

    def start():
        mark = marker()

        def told(rows, texts):
            pred, s = mark(rows, texts)
            return (pred != "und") & (s >= least)
        return told
    return keep_rows(docs, start, text)
