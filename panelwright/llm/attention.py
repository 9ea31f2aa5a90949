"""Language-model scoring with a small causal self-attention model, trained in numpy.

Words become ids: a word of at least 2^-15 of all training tokens is one id (there can be no
more than 2^15 of them), any other the ids of its unigram pieces.  A position attends to the ids before it in
its window; from its own id and from what it attends to, a softmax gives the shares of a
few dozen mixture components, and each component is a distribution over all ids.  The
chance of the next id is the mixture's.  Windows overlap: each scores a stretch of
positions once and sees some ids before the stretch, all windows of a batch at once under
one mask.

Training is spread over the corpus: from a common start (fitted on a bounded sample, to
break the symmetry) every task takes Adagrad steps over all windows of its training texts and
re-estimates the components from the shares of responsibility (stepwise EM); the tasks'
parameters are then averaged by the ids they have seen.  Counts of words and of subwords
cover every training text.  Texts are encoded once, to a scratch table of ids that training
and scoring read.

Beside the model's score stands an add-one unigram score over words.  Its counts stay
distributed: words of at least 2^-18 of all tokens, of which there can be no more than
2^18, go to the tasks, and the rest of a text's words meet their counts in a join.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ListMemo, Rows, bounded_sample, fields, kept, one_thread, over_texts, sums, text_slices, with_results
from panelwright.llm.pieces import DoubleArray, Segmenter
from panelwright.llm.vocabulary import MARK, load
from panelwright.session import scratch_path

WIDTH, PARTS, PAST, STRETCH = 16, 48, 8, 16
SPAN = PAST + STRETCH
BATCH = 256                 # windows scored at a time, and in a step of the common start
TRAIN_BATCH = 1024          # windows a step of the training over all texts
PIECE = 128                 # of them worked on at a time
WARM_ROWS, WARM_CHARS, WARM_ROUNDS = 1200, 20_000, 6    # texts of the common start, none longer
FREQUENT, UNITS = 1 << 18, 1 << 15      # a word of one in so many tokens: its count is sent to the tasks; it is an id
SMOOTH = 200.0
BLOCK = 2048                # ids in a block of parameters
START, END = 1, 2


# ---- the model -------------------------------------------------------------------
def fresh(ids: int, seed: int = 29) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
    return {"e": n(ids, WIDTH), "meet": n(WIDTH, WIDTH), "near": (-0.1 * np.arange(SPAN)).astype(np.float32),
            "own": n(WIDTH, PARTS), "seen": n(WIDTH, PARTS), "bias": np.zeros(PARTS, np.float32),
            "parts": r.gamma(1.0, 1.0, (ids, PARTS)).astype(np.float32), "ids": np.zeros(ids, np.float32)}


def components_of(m: dict) -> np.ndarray:
    """(ids, parts): each component's distribution, smoothed towards the ids' own shares."""
    prior = (m["ids"] + 0.1) / (m["ids"].sum() + 0.1 * len(m["ids"]))
    c = m["parts"] + SMOOTH * prior[:, None]
    return (c / c.sum(0)).astype(np.float32)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids seen, ids to score, text, number within the text) of every window.

    A text is START, its ids, END.  -1 marks places before a text's start and after its end.
    """
    n = np.array([len(t) for t in texts], np.int64) + 1            # ids to score
    many = -(-n // STRETCH)
    room = PAST + 1 + many * STRETCH
    first = np.cumsum(room) - room
    flat = np.full(int(room.sum()), -1, np.int32)
    for t, a, k in zip(texts, first.tolist(), n.tolist()):
        flat[a + PAST] = START
        flat[a + PAST + 1: a + PAST + k] = t
        flat[a + PAST + k] = END
    of = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[of] + at * STRETCH
    view = np.lib.stride_tricks.sliding_window_view(flat, SPAN + 1)[begin]
    return view[:, :SPAN], view[:, PAST + 1:], of, at


_BACK = np.arange(PAST, SPAN)[:, None] - np.arange(SPAN)[None, :]
_CAUSAL = (_BACK >= 0).astype(np.float32)


def _attend(asks: np.ndarray, e: np.ndarray, near: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights, not yet of sum one, of the places that each place may see."""
    s = asks @ e.transpose(0, 2, 1)
    s += near[np.maximum(_BACK, 0)]
    np.clip(s, np.float32(-40), np.float32(40), out=s)
    np.exp(s, out=s)
    s *= _CAUSAL
    gap = np.flatnonzero(seen[:, 0] < 0)        # only a text's first window has places before the start
    if len(gap):
        s[gap] *= (seen[gap] >= 0)[:, None, :]
    return s


class Scorer:
    """Log10 chances of the ids of many windows."""

    def __init__(self, m: dict):
        self.m, self.parts = m, components_of(m)
        self.e = np.concatenate([m["e"], np.ones((len(m["e"]), 1), np.float32)], 1)      # the one adds up the weights
        self.meet = np.concatenate([m["meet"], np.zeros((WIDTH, 1), np.float32)], 1)
        self.ones = np.ones(PARTS, np.float32)

    def __call__(self, seen: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """One number a place of each window."""
        m, out = self.m, np.empty((len(seen), STRETCH), np.float32)
        for lo in range(0, len(seen), BATCH):
            s, y = seen[lo: lo + BATCH], goal[lo: lo + BATCH]
            e = self.e[np.maximum(s, 0)]
            own = e[:, PAST:, :WIDTH]
            o = _attend(own @ self.meet, e, m["near"], s) @ e
            g = (o[:, :, :WIDTH] / o[:, :, WIDTH:]) @ m["seen"]
            g += own @ m["own"]
            g += m["bias"]
            np.clip(g, np.float32(-40), np.float32(40), out=g)
            np.exp(g, out=g)
            all_ = g @ self.ones
            g *= self.parts[np.maximum(y, 0)]
            p = (g @ self.ones) / all_
            out[lo: lo + BATCH] = np.log10(np.maximum(p, np.float32(1e-30)))
        return out


def _grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, where the run of each begins in ``order``, ``order``: places by id)."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], first, order


class Trainer:
    def __init__(self, m: dict, rate: float):
        self.m, self.rate = {k: v.copy() for k, v in m.items()}, rate
        self.past = {k: np.full_like(v, 1e-9) for k, v in m.items() if k not in ("parts", "ids")}
        self.dist, self.steps = components_of(self.m), 0
        self.got = np.zeros_like(m["parts"])        # responsibilities of this trainer's own windows
        self.used = np.zeros(len(m["e"]), np.float32)
        self.turn = np.zeros_like(m["e"])

    def _move(self, name, d, at=slice(None)):
        self.past[name][at] += d * d
        self.m[name][at] -= self.rate * d / np.sqrt(self.past[name][at])

    def step(self, seen: np.ndarray, goal: np.ndarray) -> float:
        """One step over all windows; ``PIECE`` of them are worked on at a time, which stay in the cache."""
        m, into = self.m, np.concatenate([self.m["own"], self.m["seen"]])
        live = (goal >= 0) & (seen[:, PAST:] >= 0)
        n = np.float32(max(np.count_nonzero(live), 1))
        total, loss, touched = {}, 0.0, []
        for lo in range(0, len(seen), PIECE):
            at = slice(lo, lo + PIECE)
            part, ids, grads = self._part(into, seen[at], goal[at], live[at].astype(np.float32).ravel(), n)
            loss += part
            touched.append(ids)
            for k, d in grads.items():
                total[k] = total[k] + d if k in total else d
        total["own"], total["seen"] = np.split(total.pop("into"), 2)
        for name, d in total.items():
            self._move(name, d)
        ids = np.unique(np.concatenate(touched))
        self._move("e", self.turn[ids], ids)
        self.turn[ids] = 0
        self.steps += 1
        if self.steps % 10 == 0:
            m["parts"] *= np.float32(0.95)
            self.got *= np.float32(0.98)
            self.dist = components_of(m | {"parts": m["parts"] + self.got})
        return float(loss / n)

    def _part(self, into, seen, goal, live, n):
        """(summed loss, ids seen, gradients) of some windows; adds to ``got``, ``used`` and ``turn``, the gradient of ``e``."""
        m, b = self.m, len(seen)
        x, y = np.maximum(seen, 0), np.maximum(goal, 0).ravel()
        e = m["e"][x]
        both = np.empty((b, STRETCH, 2 * WIDTH), np.float32)            # own, what is attended to
        pair = np.empty((b, 2 * STRETCH, WIDTH), np.float32)            # asks, do
        pull = np.empty((b, 2 * STRETCH, SPAN), np.float32)             # ds, a
        asks, do, ds, a = pair[:, :STRETCH], pair[:, STRETCH:], pull[:, :STRETCH], pull[:, STRETCH:]
        both[:, :, :WIDTH] = e[:, PAST:]
        own = both[:, :, :WIDTH].reshape(-1, WIDTH)
        asks[:] = (own @ m["meet"]).reshape(b, STRETCH, WIDTH)
        a[:] = _attend(asks, e, m["near"], seen)
        a /= a.sum(2, keepdims=True) + np.float32(1e-30)
        both[:, :, WIDTH:] = a @ e
        flat, ones = both.reshape(-1, 2 * WIDTH), np.ones(PARTS, np.float32)
        share = flat @ into
        share += m["bias"]
        np.clip(share, np.float32(-40), np.float32(40), out=share)
        np.exp(share, out=share)
        share /= (share @ ones)[:, None]
        r = self.dist[y]
        r *= share
        p = r @ ones
        r *= (live / p)[:, None]
        ids, first, order = _grouped(y)
        self.got[ids] += np.add.reduceat(r[order], first, axis=0)
        share *= live[:, None]
        share -= r
        share *= np.float32(1) / n                                      # the shares' gradient
        d = (share @ into.T).reshape(b, STRETCH, 2 * WIDTH)
        do[:] = d[:, :, WIDTH:]
        np.multiply(a, do @ e.transpose(0, 2, 1), out=ds)
        ds -= a * ds.sum(2, keepdims=True)
        d_asks = (ds @ e).reshape(-1, WIDTH)
        de = pull.transpose(0, 2, 1) @ pair
        de[:, PAST:] += d[:, :, :WIDTH]
        de[:, PAST:] += (d_asks @ m["meet"].T).reshape(b, STRETCH, WIDTH)
        grads = {"meet": own.T @ d_asks, "into": flat.T @ share, "bias": share.sum(0),
                 "near": np.bincount(np.maximum(_BACK, 0).ravel(), ds.sum(0).ravel(), SPAN).astype(np.float32)}
        ids, first, order = _grouped(x.ravel())
        self.turn[ids] += np.add.reduceat(de.reshape(-1, WIDTH)[order], first, axis=0)
        self.used[ids] += np.diff(np.append(first, len(order)))
        return -float(np.log(p) @ live), ids, grads

    def over(self, seen, goal, batch: int = BATCH):
        for lo in range(0, len(seen), batch):
            self.step(seen[lo: lo + batch], goal[lo: lo + batch])


# ---- texts to ids ----------------------------------------------------------------
class Words:
    """Ids and base scores of words; ASCII letters lower-cased; pieces have the marker before the word.

    ``known``: sorted hashes of words and their base scores.  A memo of words serves both.
    """

    def __init__(self, v, arrays, units: np.ndarray, known: tuple):
        self.segmenter, self.units, self.known, self.ids_of = Segmenter(v, arrays), units, known, len(v.pieces)
        self.h, self.log = Rows(dtype=np.int64), Rows(dtype=np.float64)
        self.memo = ListMemo(self._learn, 500_000, lambda rows: (self.h.keep(rows), self.log.keep(rows)))

    def _learn(self, words):
        flat, size = self.segmenter._learn([MARK + w.decode("utf-8", "replace") for w in words])
        h = _digest(words)
        at, hit = _find(self.units, h)
        first = np.cumsum(size) - size
        flat[first[hit]] = self.ids_of + at[hit]
        keep = np.ones(len(flat), bool)
        keep[np.repeat(hit, size)] = False
        keep[first[hit]] = True
        score = np.full(len(h), np.nan)
        at, found = _find(self.known[0], h)
        score[found] = self.known[1][at[found]]
        self.h.add(h)
        self.log.add(score)
        return flat[keep], np.where(hit, 1, size)

    def of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of every word, ids of all texts end to end, where each text ends)."""
        at = self.memo.rows(split)
        return at, *self.memo.gather(at, split)


def _find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``sorted_``, whether it is there)."""
    if not len(sorted_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return at, sorted_[at] == h


def _split(texts):
    return [(t or b"").lower().split() for t in texts]


def _digest(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """h (64-bit hash of a word), c: counts over all texts."""
    key = uuid.uuid4().hex

    def run(batches):
        kept(("counted", key), dict)        # lets what earlier stages kept go
        seen: Counter = Counter()

        def out():
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(_digest(words)), pa.array(np.fromiter(seen.values(), np.int64, len(words)))], names=["h", "c"])
        for b in batches:
            for _, texts in text_slices(b, "text"):
                for x in _split(texts):
                    seen.update(x)
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
    return train.select(F.col(text).alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def encode(rows: DataFrame, model_file: str, units: np.ndarray, known: tuple, seed: int = 31) -> tuple[DataFrame, int]:
    """(table of the encoded ``rows``, number of ids); rows have doc_id, text and train; units: sorted hashes of words.

    ids: those of the text, as bytes; n_tokens: words and the end; sure, base: number and base
    score of the words in ``known``; rare_h, rare_n: hashes and numbers of the others.
    """
    one_thread()
    spark = rows.sparkSession
    with open(model_file, "rb") as f:
        v = load(f.read())
    arrays = DoubleArray({v.pieces[i].encode(): i for i in v.matched}).arrays()
    shared, key, all_ = spark.sparkContext.broadcast((v, arrays, units, known)), uuid.uuid4().hex, len(v.pieces) + len(units)
    kind = _kind(all_)

    def start():
        own = kept(("words", key), lambda: Words(*shared.value))

        def run(b, texts):
            split = _split(texts)
            at, ids, ends = own.of(split)
            many = np.fromiter(map(len, split), np.int64, len(split))
            doc, first, log = np.repeat(np.arange(len(split)), many), np.cumsum(many) - many, own.log.data[at]
            rare = np.isnan(log)
            code, n = np.unique(doc[rare] * np.int64(1 << 32) + at[rare], return_counts=True)
            cuts = pa.array(np.searchsorted(code, np.arange(len(split) + 1) << 32).astype(np.int32))
            ids = ids.astype(kind)
            return with_results(b, {
                "ids": pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary()), "n_tokens": many + 1,
                "sure": sums((~rare).astype(np.int64), first).astype(np.int64), "base": sums(np.where(rare, 0.0, log), first),
                "rare_h": pa.ListArray.from_arrays(cuts, pa.array(own.h.data[code & ((1 << 32) - 1)])),
                "rare_n": pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))})
        return run

    d = rows.select("doc_id", "train", "text", F.monotonically_increasing_id().alias("rid"), F.length("text").alias("chars"),
                    F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    schema = fields(d, {"ids": "binary", "n_tokens": "bigint", "sure": "bigint", "base": "double", "rare_h": "array<bigint>", "rare_n": "array<int>"})
    path = scratch_path(spark, "encoded")
    over_texts(d, schema, start).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), all_


def _kind(ids: int):
    return np.uint16 if ids <= 1 << 16 else np.int32


def train(docs: DataFrame, model_file: str, units: np.ndarray, doc: str = "doc_id", text: str = "text", seed: int = 31):
    """A broadcast (key, parameters) fitted on all texts of ``docs``; units: sorted hashes of words."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("train"))
    return fit(*encode(rows, model_file, units, (np.zeros(0, np.int64), np.zeros(0)), seed), seed)


def fit(encoded: DataFrame, all_: int, seed: int = 31):
    """A broadcast (key, parameters) fitted on all encoded texts that are marked ``train``."""
    one_thread()
    spark, kind, key = encoded.sparkSession, _kind(all_), uuid.uuid4().hex
    rows = encoded.filter("train")
    m = fresh(all_)
    some = bounded_sample(rows.filter(F.col("chars").between(1, WARM_CHARS)).select("ids", "h", F.lit(1).alias("one")), "one", WARM_ROWS, [F.col("h")], seed)
    ids = [np.frombuffer(r.ids, kind).astype(np.int32) for r in some.orderBy("h").collect()]
    if ids:
        m["ids"] = np.bincount(np.concatenate(ids + [np.full(len(ids), END)]), minlength=all_).astype(np.float32)
        m["parts"] *= (m["ids"] / m["parts"].sum(1) / 4)[:, None].astype(np.float32)
        t = Trainer(m, 0.25)
        seen, goal, _, _ = windows(ids)
        r = np.random.default_rng(seed)
        for _ in range(WARM_ROUNDS):
            o = r.permutation(len(seen))
            t.over(seen[o], goal[o])
            t.m["parts"], t.got = t.got, np.zeros_like(t.got)
        m = t.m
    shared = spark.sparkContext.broadcast(m)
    flat = [k for k in sorted(m) if k not in ("e", "parts", "ids")]
    blocks = -(-all_ // BLOCK)

    def run(batches):
        one_thread()
        t = Trainer(kept(("start", key), lambda: shared.value), 0.08)
        all_ids, held = np.zeros(all_), ([], [])
        for b in batches:
            for _, texts in text_slices(b, "ids"):
                ids = [np.frombuffer(x, kind) for x in texts]
                all_ids += np.bincount(np.concatenate(ids), minlength=len(all_ids))
                all_ids[END] += len(ids)
                seen, goal, _, _ = windows(ids)
                held[0].append(seen), held[1].append(goal)
                seen, goal = np.concatenate(held[0]), np.concatenate(held[1])
                whole = len(seen) // TRAIN_BATCH * TRAIN_BATCH
                t.over(seen[:whole], goal[:whole], TRAIN_BATCH)
                held = ([seen[whole:]], [goal[whole:]])
        if held[0] and len(held[0][0]):
            t.over(held[0][0], held[1][0], TRAIN_BATCH)
        n = np.float32(t.used.sum())
        out = [(-1, np.concatenate([t.m[k].ravel() for k in flat] + [[1.0]]).astype(np.float32) * n)]
        for k in range(blocks):
            s = slice(k * BLOCK, (k + 1) * BLOCK)
            if all_ids[s].any():
                out.append((k, np.concatenate([(t.m["e"][s] * t.used[s, None]).ravel(), t.used[s], t.got[s].ravel(), all_ids[s]]).astype(np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x.tobytes() for _, x in out], pa.binary())], names=["block", "x"])

    got = rows.select("ids").mapInArrow(run, "block int, x binary")
    summed = _summed(got, "block").collect()
    m = {k: x.copy() for k, x in m.items()}
    m["ids"] = np.zeros(all_, np.float32)
    for row in summed:
        x = np.frombuffer(row.x)
        if row.block < 0:
            if x[-1] > 0:
                x, at = x[:-1] / x[-1], 0
                for k in flat:
                    m[k] = x[at: at + m[k].size].reshape(m[k].shape).astype(np.float32)
                    at += m[k].size
            continue
        lo = row.block * BLOCK
        n = min(BLOCK, all_ - lo)
        e, used, parts, ids = np.split(x, np.cumsum([n * WIDTH, n, n * PARTS]))
        hit = used > 0
        m["e"][lo: lo + n][hit] = (e.reshape(n, WIDTH)[hit] / used[hit, None]).astype(np.float32)
        m["parts"][lo: lo + n] += parts.reshape(n, PARTS)
        m["ids"][lo: lo + n] = ids
    return spark.sparkContext.broadcast((uuid.uuid4().hex, m))


def _summed(df: DataFrame, key: str) -> DataFrame:
    """Sums of float32 arrays (binary ``x``) by key, as float64 arrays; each task adds up what it holds first."""
    def add(batches):
        total: dict = {}
        for b in batches:
            for k, x in zip(b.column(key).to_pylist(), b.column("x").to_pylist()):
                x = np.frombuffer(x, np.float32).astype(np.float64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=[key, "x"])
    return df.repartition(key).mapInArrow(add, f"{key} int, x binary")


# ---- scoring ---------------------------------------------------------------------
def score(docs: DataFrame, is_train, model_file: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    ``is_train`` is a column: the rows that are learned from.  Null texts are empty, and an
    empty text is its end token alone.  Without training rows the base score is 0 and the
    model is the untrained one.  Rows of equal id are rows of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train"))
    learn = rows.filter("train")
    path = scratch_path(spark, "word-counts")
    word_counts(learn).write.parquet(path)
    counts = spark.read.schema("h bigint, c bigint").parquet(path)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = learn.count()
    n, kinds = total + ends, kinds + (ends > 0)
    often = counts.filter(F.col("c") * FREQUENT >= n).toArrow()
    order = np.argsort(often.column("h").to_numpy())
    h, c = often.column("h").to_numpy()[order], often.column("c").to_numpy()[order]
    unit = float(n + kinds + 1)
    encoded, all_ = encode(rows, model_file, h[c * UNITS >= n], (h, np.log10((c + 1) / unit)))
    model, kind = fit(encoded, all_), _kind(all_)
    end_base, end_known = float(np.log10((ends + 1) / unit)), int(ends > 0)

    def start():
        scorer = kept(("scored", model.value[0]), lambda: Scorer(model.value[1]))

        def run(b, texts):
            seen, goal, owner, _ = windows([np.frombuffer(x, kind) for x in texts])
            return with_results(b, {"score": np.bincount(owner, np.where(goal >= 0, scorer(seen, goal), 0).sum(1), len(texts))}, ("ids",))
        return run

    whole = encoded.select("rid", "doc_id", "train", "n_tokens", "sure", "base", "ids")
    whole = over_texts(whole, fields(whole, {"score": "double"}, ("ids",)), start, "ids")
    whole = whole.select("rid", F.struct(*[x for x in whole.columns if x != "rid"]).alias("info"), F.lit(0.0).alias("b"), F.lit(0).cast("bigint").alias("k"))
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("w")).select("rid", F.col("w.rare_h").alias("h"), F.col("w.rare_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = rare.join(counts, "h", "left").select("rid", F.lit(None).cast(whole.schema["info"].dataType).alias("info"),
                                                (F.col("n") * F.log10((c + 1) / F.lit(unit))).alias("b"), F.when(c > 0, F.col("n")).otherwise(0).cast("bigint").alias("k"))
    done = whole.union(met).groupBy("rid").agg(F.first("info", ignorenulls=True).alias("info"), F.sum("b").alias("b"), F.sum("k").alias("k"))
    return done.select("info.doc_id", (~F.col("info.train")).alias("held_out"), "info.n_tokens",
                       (F.col("info.sure") + F.col("k") + end_known).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                       (F.col("info.base") + end_base + F.col("b")).alias("base_score"), F.col("info.score").alias("score"))
