"""What the corpus operators share: passes over whole texts, word memos, samples, buckets, components.

A *pass* is one ``mapInArrow`` over the rows of a frame: texts are handled whole, a
few megabytes at a time, and a row is read once.  Words are the runs of bytes other
than ASCII white space; as most words of a corpus repeat, per-word work is kept in a
bounded memo of the Python worker and done anew only for words that it lacks.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut

SLICE_BYTES = 4 << 20

_KEPT: dict = {}


def kept(key, build: Callable):
    """One object for the life of a Python worker; another key replaces it, whatever its kind.

    Workers are used again by later stages, so what each stage keeps would otherwise add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back() -> None:
    """Hands freed memory to the system where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def one_thread() -> None:
    """A Spark task is the unit of parallel work; libraries inside it must not start threads."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


# ---- passes over texts ---------------------------------------------------------
def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts as bytes, None where null), some megabytes of text at a time."""
    texts = batch.column(column).cast(pa.binary() if batch.column(column).type != pa.large_string() else pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def over_texts(df: DataFrame, schema: str, start: Callable, text: str = "text") -> DataFrame:
    """``start()`` is called once a task and gives f(rows, texts) -> RecordBatch of ``schema``."""
    def run(batches):
        one_thread()
        f = start()
        for batch in batches:
            for rows, texts in text_slices(batch, text):
                if (out := f(rows, texts)).num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def with_results(rows: pa.RecordBatch, results: dict, drop=("text",)) -> pa.RecordBatch:
    """The rows' columns but ``drop``, then the results; a result replaces a column of its name."""
    names = [n for n in rows.schema.names if n not in results and n not in drop]
    return pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [v if isinstance(v, pa.Array) else pa.array(v) for v in results.values()],
                                      names=names + list(results))


def keep_rows(df: DataFrame, start: Callable, text: str = "text") -> DataFrame:
    """The rows that f(rows, texts) marks, f = ``start()``; all columns as they are.

    Only the text goes to Python (``rows`` holds that column alone), and only a flag comes back.
    """
    @F.arrow_udf("boolean")
    def marked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one_thread()
        f = start()
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            yield pa.chunked_array([pa.array(f(rows, texts), pa.bool_()) for rows, texts in text_slices(batch, "text")] or [[]], pa.bool_()).combine_chunks()
    return df.filter(marked(F.col(text)))


def fields(df: DataFrame, results: dict, drop=("text",)) -> str:
    """The schema that ``with_results`` gives."""
    kept_ = [f for f in df.schema.fields if f.name not in results and f.name not in drop]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_] + [f"`{k}` {v}" for k, v in results.items()])


# ---- word memo -----------------------------------------------------------------
class _Index(dict):
    def __init__(self):
        self.fresh: list = []

    def __missing__(self, word):
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


class WordMemo:
    """Row numbers of words; ``learn(new words)`` is called for those not yet known.

    At ``limit`` words the memo keeps those met at least twice, half of ``limit`` at
    most, and ``keep(their rows)`` is called; so its memory is bounded whatever the
    vocabulary, and results do not depend on it.
    """

    def __init__(self, learn: Callable, keep: Callable, limit: int = 400_000):
        self.index, self.learn, self.keep, self.limit = _Index(), learn, keep, limit
        self.met = np.zeros(1024, np.int64)

    def rows(self, words: list) -> np.ndarray:
        if len(self.index) > self.limit:
            self._shrink()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        while len(self.met) < len(self.index):
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        if len(at):
            n = np.bincount(at)
            self.met[: len(n)] += n
        return at

    def _shrink(self):
        met = self.met[: len(self.index)]
        least = max(2, int(np.partition(met, -self.limit // 2)[-self.limit // 2]) + 1) if len(met) > self.limit // 2 else 2
        rows = np.flatnonzero(met >= least)
        words, self.index = list(self.index), _Index()
        for i, r in enumerate(rows.tolist()):
            self.index[words[r]] = i
        self.met = np.concatenate([met[rows], np.zeros(1024, np.int64)])
        self.keep(rows)


class Rows:
    """An array that rows are added to."""

    def __init__(self, width: tuple = (), dtype=np.float32):
        self.n, self.data = 0, np.empty((1024, *width), dtype)

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n: self.n + len(more)] = more
        self.n += len(more)

    def keep(self, rows: np.ndarray) -> None:
        self.data[: len(rows)] = self.data[rows]
        self.n = len(rows)


class ListMemo:
    """Integer lists of words: ``learn(new words)`` gives their lists end to end, and the sizes; ``also`` is told which rows stay."""

    def __init__(self, learn: Callable, limit: int = 500_000, also: Callable | None = None):
        self.make, self.also = learn, also
        self.ids, self.start, self.size = Rows(dtype=np.int32), Rows(dtype=np.int64), Rows(dtype=np.int64)
        self.memo = WordMemo(self._learn, self._keep, limit)

    def _learn(self, words):
        flat, size = self.make(words)
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(flat)

    def _keep(self, rows):
        size = self.size.data[rows]
        start = np.cumsum(size) - size
        self.ids.keep(np.repeat(self.start.data[rows] - start, size) + np.arange(int(size.sum())))
        self.size.keep(rows)
        self.start.keep(rows)
        self.start.data[: len(rows)] = start
        if self.also:
            self.also(rows)

    def rows(self, split: list[list]) -> np.ndarray:
        """Rows of all words of all texts end to end."""
        return self.memo.rows([w for x in split for w in x])

    def lists(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of all words of all texts end to end, where each text ends)."""
        return self.gather(self.rows(split), split)

    def gather(self, at: np.ndarray, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words whose rows are known."""
        start, size = self.start.data[at], self.size.data[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        words = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return self.ids.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends[words]


def word_ngrams(words: list[bytes], sizes: tuple, buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram of ``<word>``, first n-gram of each word); with ``whole`` the word itself counts as one."""
    flat = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    room = np.repeat(ends, lens) - np.arange(len(flat))
    mult = np.uint64(0x9E3779B97F4A7C15)
    found, owners, h = [], [], np.zeros(len(flat), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1:] + np.uint64(1)
        if n in sizes:
            ok = room[: len(h)] >= n
            found.append(((h[ok] + np.uint64(n)) * mult) >> np.uint64(32))
            owners.append(owner[: len(h)][ok])
    if whole:
        power = np.cumprod(np.full(int(lens.max(initial=1)), 0x100000001B3, np.uint64))
        at = np.arange(len(flat)) - np.repeat(ends - lens, lens)
        found.append((np.add.reduceat(flat * power[at], ends - lens) * mult) >> np.uint64(32))
        owners.append(np.arange(len(words)))
    h, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts``; an empty run gives zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[np.append(starts[1:], len(values))] - total[starts]


# ---- choosing rows -------------------------------------------------------------
def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds`` (of empty text where the key is null)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, by: str, most: int, key: list[Column], seed: int) -> DataFrame:
    """Up to ``most`` rows of each class ``by``, those of least hash; the same rows in every run.

    For classes of a model, which the driver holds anyway.  Rows are first thinned where
    they are read, at a rate found from exact counts, so that the ordering of a frequent
    class never holds more than about twice ``most`` rows.
    """
    h = F.xxhash64(F.lit(seed), *key)
    rates = [(r[0], min(1.0, (2.0 * most + 40) / r[1])) for r in df.groupBy(by).count().collect() if r[0] is not None]
    if not rates:
        return df.limit(0)
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates for x in pair]), F.col(by))
    thin = df.withColumn("__h", h).filter(F.pmod("__h", F.lit(1 << 20)) / float(1 << 20) < rate)
    w = Window.partitionBy(by).orderBy("__h")
    return thin.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__h", "__r")


# ---- buckets of candidates -----------------------------------------------------
def spread(df: DataFrame, key: str, row: Column, limit: int, weight: Column | None = None) -> DataFrame:
    """Adds ``lo``, ``hi`` and ``own``: the pair of blocks in which a row meets others of its key.

    Keys of up to ``limit`` rows (or whole ``weight``) have the one pair (0, 0).  A larger key is dealt to
    blocks of about that size, and each row goes to every pair its block (``own``)
    is part of, so that any two rows of the key still meet and no task holds the key.
    """
    big = df.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n")).filter(F.col("__n") > limit)
    blocks = F.ceil(F.coalesce("__n", F.lit(1)) / float(limit)).cast("int")
    d = (df.join(big, key, "left").withColumn("__b", blocks)
         .withColumn("own", F.pmod(F.xxhash64(F.lit(7), row), F.col("__b")).cast("int")))
    one = F.array(F.lit(0))
    d = d.withColumn("__o", F.explode(F.when(F.col("__b") == 1, one).otherwise(F.sequence(F.lit(0), F.col("__b") - 1))))
    return d.withColumns({"lo": F.least("own", "__o"), "hi": F.greatest("own", "__o")}).drop("__n", "__b", "__o")


def whole_runs(batches, columns: list[str], rows: int = 50_000, size: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``columns`` from sorted batches, of about ``rows`` rows or ``size`` bytes; a run is never cut."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows and sum(b.nbytes for b in held) < size:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(len(t), bool)
        for c in columns:
            v = t.column(c).to_numpy()
            same &= v == v[-1]
        cut_at = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut_at:
            yield t.slice(0, cut_at)
        rest = t.slice(cut_at)
        held, n = rest.to_batches(), len(rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Where the runs begin."""
    new = np.ones(len(t), bool)
    same = np.ones(max(len(t) - 1, 0), bool)
    for c in columns:
        v = t.column(c).to_numpy()
        same &= v[1:] == v[:-1]
    new[1:] = ~same
    return np.flatnonzero(new)


def tree(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of 0..n-1 under the links a-b (labels fall to the least, then are halved)."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        least = least[least]
        if (least == before).all():
            break
    return least


# ---- components ----------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b); the component is its least node.

    Alternates two local steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to its least neighbour.  Neighbour sets are
    never gathered; a step is a minimum by node and a join with it, and each round is
    written to the checkpoint folder.
    """
    e = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
                .filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
