"""Phrase collocations from a weighted de Bruijn graph of words.

Texts fall into pieces and pieces into words.  Every word starts one *longest gram* of
``most_words`` words, cut short only where its piece ends; these are the edges of the
graph, from the node of a gram's first words to that of its last, with a weight.  Only they
are counted.  What flows out of a node, and the edges cut short in it where a piece ends,
add up to the node's own count, and so on down to single words: a shorter phrase is never
counted by itself.

Where all that passes a node comes by one edge and leaves by one edge, the two are one:
such unary paths are compacted to passages.  A phrase inside a passage is never reported,
as the longer phrase around it is as frequent.

Words stand as 64-bit hashes of (language, word) while they are counted.  A dictionary of
all words is made first and shows that no two share a hash; otherwise it is made anew from
another seed.  Edges are dealt out by their first word; of a word that is too frequent for
one task, by the first two, and so on, and the partial counts are added up afterwards.
Sorted edges are counted as they stream by.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import text_slices
from panelwright.session import cut, partitions

ENDS = b".,;:!?\n\x0b\x0c\r"
_FROM = bytes(range(65, 91)) + b"\t" + ENDS
_TABLE = bytes.maketrans(_FROM, bytes(range(97, 123)) + b" " + b"\n" * len(ENDS))
STOP = b"\n"                    # stands in word lists where a piece ends
HOLD, CHUNK, WORDS, PART = 1 << 21, 200_000, 400_000, 100_000
DEALT = 64                      # numbers that edges are dealt by, for each partition
SLICES = 64


def marked(text: bytes | None) -> list[bytes]:
    """Words of a text, with STOP after each piece."""
    t = (text or b"").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    t.append(STOP)
    return [w for w in t if w]


class _Hash:
    """Hash of (language, word); 0 is left for "no word"."""

    def __init__(self, seed: int):
        from xxhash import xxh3_64_intdigest

        self.f, self.seed, self.seeds = xxh3_64_intdigest, seed, {}

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.seeds:
            self.seeds[lang] = self.f(lang.encode(), self.seed)
        h = np.fromiter(map(self.f, words, repeat(self.seeds[lang])), np.uint64, len(words))
        h[h == 0] = 1
        return h


# ---- dictionary ------------------------------------------------------------------
def _dictionary(texts: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, n) of all words; STOP is among them with n = 0."""
    def run(batches):
        h, held, many = _Hash(seed), {}, 0

        def rows():
            for lang, c in held.items():
                words = list(c)
                yield pa.RecordBatch.from_arrays([pa.array(h.of(lang, words).view(np.int64)), pa.array([lang] * len(words)), pa.array(words, pa.binary()),
                                                  pa.array(np.fromiter(c.values(), np.int64, len(words)))], names=["h", "lang", "word", "n"])
        for batch in batches:
            for part, raw in text_slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), raw):
                    if lang not in held:
                        held[lang] = Counter({STOP: 0})
                    c, before = held[lang], len(held[lang])
                    c.update((text or b"").translate(_TABLE).split())
                    many += len(c) - before
                if many > WORDS:
                    yield from rows()
                    held, many = {}, 0
        yield from rows()
    parts = texts.mapInArrow(run, "h bigint, lang string, word binary, n bigint")
    return cut(parts.repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n")))


def dictionary(texts: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """The dictionary and the seed with which no two of its words share a hash."""
    while True:
        d = _dictionary(texts, seed)
        if d.groupBy("h").count().filter("count > 1").isEmpty():
            return d, seed
        seed += 1


# ---- edges -----------------------------------------------------------------------
def _bits(most_words: int) -> int:
    return 63 // most_words


def _groups(words: list[np.ndarray], n: np.ndarray, key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sums of ``n`` over equal tuples of words, in the order of ``key`` (a function of the words)."""
    mixed = np.zeros(len(n), np.uint64)
    for w in words:
        mixed = (mixed ^ w) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed, key))
    words, key = [w[order] for w in words], key[order]
    new = np.ones(len(n), bool)
    if len(n):
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    at = np.flatnonzero(new)
    return [w[at] for w in words], np.add.reduceat(n[order], at) if len(at) else n[:0], key[at]


def _sort_key(words: list[np.ndarray], bits: int) -> np.ndarray:
    key = np.zeros(len(words[0]), np.uint64)
    for w in words:
        key = (key << np.uint64(bits)) | (w >> np.uint64(64 - bits))
    return key


def _is_hot(w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(w), bool)
    return hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w


def _edges(texts: DataFrame, seed: int, most_words: int, hot: np.ndarray) -> DataFrame:
    """(p, w1, ..., n): longest grams counted within a task; p, a small number, deals them out."""
    bits, many_parts = _bits(most_words), np.uint64(DEALT * partitions(texts.sparkSession))
    names = [f"w{i + 1}" for i in range(most_words)]
    schema = "p bigint, " + ", ".join(f"{c} bigint" for c in names) + ", n bigint"
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        h, held, many, stops = _Hash(seed), [], 0, {}

        def rows():
            flat = np.concatenate([*held, np.zeros(most_words, np.uint64)])
            words = [flat[: len(flat) - most_words + 1]]
            for i in range(1, most_words):
                w = flat[i: len(words[0]) + i].copy()
                w[words[-1] == 0] = 0
                words.append(w)
            some = words[0] != 0
            words = [w[some] for w in words]
            words, n, key = _groups(words, np.ones(len(words[0]), np.int64), _sort_key(words, bits))
            p, spread = words[0].copy(), np.ones(len(n), bool)
            for a, b in zip(words, words[1:]):
                spread &= _is_hot(a, shared.value)
                p[spread] = (p[spread] ^ (b[spread] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
            p = (p >> np.uint64(20)) % many_parts
            for lo in range(0, len(n), PART):
                cols = [x[lo: lo + PART].view(np.int64) for x in (p, *words)] + [n[lo: lo + PART]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["p", *names, "n"])
        for batch in batches:
            for part, raw in text_slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), raw):
                    a = h.of(lang, marked(text))
                    if lang not in stops:
                        stops[lang] = h.of(lang, [STOP])[0]
                    a[a == stops[lang]] = 0
                    held.append(a)
                    many += len(a)
                    if many > HOLD:
                        yield from rows()
                        held, many = [], 0
        if held:
            yield from rows()
    return texts.mapInArrow(run, schema)


def sorted_edges(edges: DataFrame, most_words: int, many: int) -> DataFrame:
    """Edges dealt to tasks and ordered by k, which is ``_sort_key`` of their words, computed where they arrive."""
    bits = _bits(most_words)
    tops = [F.shiftleft(F.shiftrightunsigned(f"w{i + 1}", 64 - bits), bits * (most_words - 1 - i)) for i in range(most_words)]
    key = tops[0]
    for t in tops[1:]:
        key = key.bitwiseOR(t)
    return edges.repartition(many, "p").drop("p").withColumn("k", key).sortWithinPartitions("k")


class _Level:
    """Counts of the grams of one length in a stream ordered by key; a gram is complete once the key has moved on."""

    def __init__(self, length: int, shift: int):
        self.length, self.shift, self.left = length, np.uint64(shift), None

    def settle(self, words, n, key, final: bool):
        """Complete groups (words, n, key) of what has come so far."""
        words = words[: self.length]
        if self.left is not None:
            words = [np.concatenate(x) for x in zip(self.left[0], words)]
            n, key = np.concatenate([self.left[1], n]), np.concatenate([self.left[2], key])
        words, n, key = _groups(words, n, key >> self.shift << self.shift)
        end = len(n) if final or not len(n) else int(np.searchsorted(key, key[-1]))
        self.left = ([w[end:] for w in words], n[end:], key[end:])
        return [w[:end] for w in words], n[:end], key[:end]


def _counted(edges: DataFrame, most_words: int, least: int, hot: np.ndarray) -> DataFrame:
    """(w1, ..., n) of grams of every length with n >= ``least``; of grams dealt to several tasks, the parts."""
    bits = _bits(most_words)
    names = [f"w{i + 1}" for i in range(most_words)]
    shared = edges.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        levels = [_Level(d, bits * (most_words - d)) for d in range(most_words, 0, -1)]

        def rows(held, final):
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            col = (lambda c: t.column(c).to_numpy()) if t else lambda c: np.empty(0, np.int64)
            state = [col(c).view(np.uint64) for c in names], col("n"), col("k").view(np.uint64)
            for level in levels:
                state = level.settle(*state, final)
                words, n, _ = state
                parts = np.logical_and.reduce([_is_hot(w, shared.value) for w in words]) if level.length < most_words else np.zeros(len(n), bool)
                go = (words[-1] != 0) & ((n >= least) | parts)
                if go.any():
                    out = [w[go].view(np.int64) for w in words] + [np.zeros(int(go.sum()), np.int64)] * (most_words - level.length)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(n[go])], names=[*names, "n"])
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= CHUNK:
                yield from rows(held, False)
                held, many = [], 0
        yield from rows(held, True)
    return edges.mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", n bigint")


def gram_counts(texts: DataFrame, words: DataFrame, seed: int, most_words: int, least: int) -> DataFrame:
    """(gram, n): grams of 1 to ``most_words`` word hashes that come ``least`` times or more, written down."""
    many = partitions(texts.sparkSession)
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") > max(total // (4 * many), least)).select("h").toPandas()["h"]     # 4 * many at most
    hot = np.sort(often.to_numpy(np.int64).view(np.uint64))
    e = sorted_edges(_edges(texts, seed, most_words, hot), most_words, many)
    names = [f"w{i + 1}" for i in range(most_words)]
    g = _counted(e, most_words, least, hot).groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return cut(g.select(F.filter(F.array(*names), lambda x: x != 0).alias("gram"), "n"))


# ---- passages --------------------------------------------------------------------
def _first(g: Column | str, n: Column | int) -> Column:
    return F.slice(g, 1, n)


def passages(grams: DataFrame, most_words: int) -> DataFrame:
    """(gram, head, hops): longest grams on unary paths, the first gram of the path and the steps from there.

    A node is inside a path if one edge brings all that passes it and one takes all of it
    away.  Heads are found by doubling pointers, in as many rounds as the longest path has
    binary digits; only grams on such paths take part.
    """
    edge = grams.filter(F.size("gram") == most_words)
    node = grams.filter(F.size("gram") == most_words - 1).select(F.col("gram").alias("node"), "n")
    into = edge.select(F.slice("gram", 2, most_words - 1).alias("node"), "n", F.col("gram").alias("before"))
    out = edge.select(_first("gram", most_words - 1).alias("node"), "n", F.col("gram").alias("gram"))
    steps = node.join(into, ["node", "n"]).join(out, ["node", "n"]).select("gram", "before")
    heads = steps.select(F.col("before").alias("gram")).join(steps.select("gram"), "gram", "left_anti")
    at = cut(steps.select("gram", F.col("before").alias("head"), F.lit(1).cast("bigint").alias("hops"))
             .union(heads.select("gram", F.col("gram").alias("head"), F.lit(0).cast("bigint"))))
    while True:
        up = at.select(F.col("gram").alias("head"), F.col("head").alias("up"), F.col("hops").alias("more"))
        if at.join(up.filter("more > 0"), "head", "left_semi").isEmpty():
            return at
        at = cut(at.join(up, "head").select("gram", F.col("up").alias("head"), (F.col("hops") + F.col("more")).alias("hops")))


def inside(paths: DataFrame, most_words: int) -> DataFrame:
    """Nodes (gram) inside passages."""
    return paths.filter("hops > 0").select(_first("gram", most_words - 1).alias("gram"))


# ---- phrases ---------------------------------------------------------------------
def scored(grams: DataFrame, phrases: DataFrame) -> DataFrame:
    """(gram, a, l, r, score) of ``phrases`` (gram, n) at the cut of lowest score, ties to the smallest."""
    c = phrases.select("gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    c = c.withColumns({"left": _first("gram", F.col("k")), "right": F.slice("gram", F.col("k") + 1, F.size("gram"))})
    c = c.join(grams.select(F.col("gram").alias("left"), F.col("n").alias("l")), "left")
    c = c.join(grams.select(F.col("gram").alias("right"), F.col("n").alias("r")), "right")
    a, l, r = (F.col(x).cast("decimal(16,0)") for x in "alr")
    score = F.call_function("div", (a * a).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (l * r).cast("decimal(32,0)"))
    best = c.groupBy("gram").agg(F.min(F.struct(score.cast("bigint").alias("score"), "k", "a", "l", "r")).alias("b"))
    return best.select("gram", "b.a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000,
                 text: str = "text", lang: str = "lang", show_passages: bool = False) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``most_words`` words and come ``least`` times or more; those go that lie
    in a longer such phrase with at least ``share`` % of their count.  Ranks follow score,
    then count, then the phrase in byte order.  With ``show_passages`` in_passage tells how many
    words the passage has that a phrase of ``most_words`` words lies in (null: none).

    A null language counts as ``und``; null and empty texts have no words; repeated rows count
    again; whole texts are read; an empty table gives no rows.
    """
    if most_words < 2:
        raise ValueError("a phrase has two words or more")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words, seed = dictionary(texts)
    grams = gram_counts(texts, words, seed, most_words, least)
    paths = passages(grams, most_words)
    phrases = grams.filter(F.size("gram") > 1)
    longer = phrases.filter(F.size("gram") > 2).select("n", F.explode(F.array(
        _first("gram", F.size("gram") - 1), F.slice("gram", F.lit(2), F.size("gram") - 1))).alias("gram"))
    longer = longer.groupBy("gram").agg(F.max("n").alias("around"))
    free = phrases.join(inside(paths, most_words), "gram", "left_anti") if share <= 100 else phrases
    free = free.join(longer, "gram", "left").filter(f"around IS NULL OR 100 * around < {share} * n").drop("around")
    s = scored(grams, free)
    # words by their hashes, phrase by phrase
    known = words.filter(F.col("n") >= least).select("h", "lang", F.col("word").cast("string").alias("word"))
    spelt = (s.select("*", F.posexplode("gram").alias("at", "h")).join(known, "h")
             .groupBy("gram", "a", "l", "r", "score", "lang")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("gram"), F.lit(SLICES))
    some = spelt.withColumn("__r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("__r") <= top).drop("__r")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = ranked.join(n, "lang")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if show_passages:
        size = paths.groupBy("head").agg((F.max("hops") + most_words).alias("in_passage"))
        ranked = ranked.join(paths.join(size, "head").select("gram", "in_passage"), "gram", "left")
        names.append("in_passage")
    return ranked.select(names)
