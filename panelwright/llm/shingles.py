"""Near copies by five-word shingles: texts are linked when the sets of their shingles have a Jaccard similarity of at least 0.8.

Texts are lower-cased (A-Z) and cut to words at ASCII white space; a text of five words
or fewer has one shingle, a text without words none (such texts are alike).  Candidates
come from MinHash: 24 keys of 4 minima each, so that a pair of similarity s shares a key
with chance 1 - (1 - s^4)^24 (0.999997 at 0.8, more above).  Of keys with the same
texts one is kept.  The texts of a key come to a task with the SimHash fingerprint and
the set of their shingles: the fingerprints are compared as bit planes, pairs that differ
in at most 28 bits (at similarity 0.8 all but one in a million; unlike texts differ in 32)
are decided by the exact similarity of the two sets of 64-bit hashes.

Pairs never leave the task.  They are taken by their distance in the key's order, and
what is found joins components at once, so that rows joined already are not compared
and a key gives fewer links than it has texts, however many of its pairs are similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Rows, WordMemo, components, fields, kept, one_thread, over_texts, run_starts, spread, whole_runs, with_results
from panelwright.llm.planes import close_at, majority
from panelwright.session import cut

WIDTH, LEAST, BANDS, EACH, SEED = 5, 0.8, 24, 4, 42
RADIUS = 28                                 # bits in which the fingerprints of similar texts may differ
BLOCK, BLOCK_BYTES = 4096, 32 << 20
ROUNDS = (0, 2, 16, 128, 1024, 1 << 62)     # distances in a run's order at which the pairs met so far are decided
PENDING = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of all shingles of texts, repeats included, and how many each text has."""

    def __init__(self, width: int = WIDTH, seed: int = SEED):
        self.width, self.seed, self.h = width, seed, Rows(dtype=np.uint64)
        self.memo = WordMemo(self._learn, self.h.keep)

    def _learn(self, words):
        from xxhash import xxh64_intdigest

        self.h.add(np.fromiter((xxh64_intdigest(w, self.seed) for w in words), np.uint64, len(words)))

    def __call__(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, split), np.int64, len(split))
        many = np.where(n > 0, np.maximum(n - self.width + 1, 1), 0)
        at = self.memo.rows([w for x in split for w in x])
        h = np.concatenate([self.h.data[at], np.zeros(self.width, np.uint64)])
        first = np.cumsum(n) - n
        begin = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        end = np.repeat(first + n, many)
        out = np.zeros(len(begin), np.uint64)
        for j in range(self.width):
            out = out * MULT + np.where(begin + j < end, h[begin + j] | np.uint64(1), np.uint64(0))
        return _mix(out), many


def _split(texts: list) -> list[list]:
    return [(t or b"").lower().split() for t in texts]


def band_keys(h: np.ndarray, many: np.ndarray, bands: int = BANDS, each: int = EACH, seed: int = SEED) -> np.ndarray:
    """(texts with shingles, bands) keys of minima over each text's shingles."""
    starts = (np.cumsum(many) - many)[many > 0]
    odd = np.random.default_rng(seed).integers(0, 1 << 31, bands * each, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for a in odd[b * each: (b + 1) * each]:
            key = _mix(key * MULT + np.minimum.reduceat(low * a, starts))
        out[:, b] = key
    return out


def sketches(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), node (hash of its words; 0 without words), size (its shingles), keys: a row for each row of ``docs``."""
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    results = {"node": "bigint", "size": "bigint", "keys": "array<bigint>"}

    def start():
        from xxhash import xxh64_intdigest

        hasher = kept(("shingles", (WIDTH, SEED)), Hasher)

        def run(b, texts):
            split = _split(texts)
            h, many = hasher(split)
            keys = np.zeros((0, BANDS), np.uint64) if not many.any() else band_keys(h, many)
            node = np.fromiter((xxh64_intdigest(b" ".join(w), SEED) if w else 0 for w in split), np.uint64, len(split))
            ends = np.concatenate([[0], np.cumsum(np.where(many > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            return with_results(b, {"node": pa.array(node.view(np.int64)), "size": pa.array(many), "keys": lists})
        return run
    return over_texts(rows, fields(rows, results), start)


def _sets():
    """node, fp (SimHash of the distinct shingles) and set (their hashes) of each row's text."""
    one_thread()
    hasher = kept(("shingles", (WIDTH, SEED)), Hasher)

    def run(rows, texts):
        h, many = hasher(_split(texts))
        sets = [np.unique(x) for x in np.split(h, np.cumsum(many)[:-1])]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.view(np.int64)))
        return with_results(rows, {"fp": pa.array(majority(flat, n).view(np.int64)), "set": lists})
    return run


def spanning_links(fp: np.ndarray, run: np.ndarray, apart: np.ndarray, size: np.ndarray, flat: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of similar rows of one run, as few as join what all of its similar pairs would join.

    ``size`` and ``flat``: the rows' sets end to end; rows of equal ``apart`` (-1: none) are not compared.
    Pairs whose fingerprints are close are decided by their sets, unless other links join them already.
    """
    ids = np.unique(flat, return_inverse=True)[1]
    end = np.cumsum(size)
    begin = end - size
    comp, marked = np.arange(len(fp)), np.zeros(len(ids), np.int8)
    left, right = [], []

    def decide(i, j):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for at, js in zip(i[first].tolist(), np.split(j, first[1:])):
            js = js[comp[js] != comp[at]]
            if not len(js):
                continue
            own = ids[begin[at]: end[at]]
            marked[own] = 1
            for js in np.split(js, np.flatnonzero(np.diff(np.cumsum(size[js]) >> 20)) + 1):
                n = size[js]
                start = np.cumsum(n) - n
                both = np.add.reduceat(marked[ids[np.repeat(begin[js] - start, n) + np.arange(int(n.sum()))]], start, dtype=np.int64)
                for other in js[both >= least * (len(own) + n - both) - 1e-9].tolist():
                    if comp[other] != comp[at]:
                        left.append(at), right.append(other)
                        comp[comp == comp[other]] = comp[at]
            marked[own] = 0

    held, n, stops = [], 0, iter(ROUNDS[1:])
    stop = next(stops)
    for d, i, j in close_at(fp, run, RADIUS):
        if held and (n > PENDING or d >= stop):
            decide(*map(np.concatenate, zip(*held)))
            held, n = [], 0
        while d >= stop:
            stop = next(stops)
        use = (comp[i] != comp[j]) & ((apart[i] != apart[j]) | (apart[i] < 0))
        use &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
        if use.any():
            held.append((i[use], j[use]))
            n += len(held[-1][0])
    if held:
        decide(*map(np.concatenate, zip(*held)))
    return np.array(left, np.int64), np.array(right, np.int64)


def _linked(least: float):
    def run(batches):
        one_thread()
        columns = ["key", "lo", "hi"]
        for t in whole_runs(batches, columns, 4_000, BLOCK_BYTES):
            starts = run_starts(t, columns)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
            sets = t.column("set").combine_chunks()
            apart = np.where(t.column("lo").to_numpy() < t.column("hi").to_numpy(), t.column("own").to_numpy(), -1)
            i, j = spanning_links(t.column("fp").to_numpy().view(np.uint64), of, apart,
                                  pc.list_value_length(sets).to_numpy().astype(np.int64), pc.list_flatten(sets).to_numpy(), least)
            if len(i):
                node = t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])
    return run


def near_copies(docs: DataFrame, least: float = LEAST, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and ``component``: a row for each row of ``docs``; rows alike or linked through others have one component."""
    rows = cut(sketches(docs, doc, text))
    prints = cut(rows.groupBy("node").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keyed = prints.select("node", "size", F.explode("keys").alias("key"))
    groups = (keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "node")).alias("y"))
              .filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")))
    met = cut(keyed.join(groups.select("key"), "key"))
    wanted = prints.join(met.select("node").distinct(), "node", "left_semi").select("th", "node")
    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(wanted, "th").select("node", "text").dropDuplicates(["node"])
    sets = cut(over_texts(texts, "node bigint, fp bigint, `set` array<bigint>", _sets))
    large = F.greatest(F.lit(1), F.ceil(F.col("size") * 8 * BLOCK / BLOCK_BYTES)).cast("bigint")
    runs = spread(met, "key", F.col("node"), BLOCK, large).select("key", "lo", "hi", "own", "node").join(sets, "node")
    links = runs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(_linked(least), "a bigint, b bigint")
    comp = components(links)
    return rows.select("doc_id", "th", "node").join(comp, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("component"))
