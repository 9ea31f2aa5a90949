"""SimHash near-duplicates by bit-sliced comparison.

Texts are lower-cased (A-Z), cut to words at ASCII white space and hashed in shingles of
four words, repeats included; a bit of the fingerprint is set if it is set in over half
of the shingles' hashes.  Two fingerprints within r bits agree in at least b - r of any
b blocks of bits, so they meet under the key of some b - r blocks.  In a sorted stream
of keys the fingerprints are stored as 64 vertical bit planes: the distances of all
rows to the rows d places on are counted 64 at a time by carry-save adders over the
planes, and a word of 64 pairs is given up once all its counts exceed the radius.

The number of blocks follows from the number of fingerprints and changes only how
much is compared, never what is found.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, fields, over_texts, run_starts, spread, tree, whole_runs, with_results
from panelwright.llm.planes import close_pairs, majority
from panelwright.llm.shingles import near_copies
from panelwright.session import cut

WORDS, SEED, RADIUS = 4, 42, 4
BLOCK = 4096


def _hashes(texts: list, width: int, seed: int) -> tuple[list[int], list[int]]:
    """Hashes of all shingles of the texts, and how many each text has."""
    from xxhash import xxh64_intdigest as digest

    out, many = [], []
    for t in texts:
        w = (t or b"").lower().split()
        if len(w) <= width:
            many.append(1 if w else 0)
            if w:
                out.append(digest(b" ".join(w), seed))
            continue
        joined = b" ".join(w)
        ends = list(itertools.accumulate(len(x) + 1 for x in w))
        starts = [0, *ends[:-1]]
        out.extend([digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])])
        many.append(len(w) - width + 1)
    return out, many


def fingerprint_array(texts: list, width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints; texts without words have 0."""
    h, many = _hashes(texts, width, seed)
    return majority(np.array(h, np.uint64), np.array(many, np.int64))


def fingerprints(docs: DataFrame, text: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without the text, with ``fp`` (the fingerprint as a signed long)."""
    results = {"fp": "bigint"}

    def start():
        return lambda rows, texts: with_results(rows, {"fp": pa.array(fingerprint_array(texts, width, seed).view(np.int64))}, (text,))
    return over_texts(docs, fields(docs, results, (text,)), start, text)


def _links(radius: int):
    def run(batches):
        for t in whole_runs(batches, ["key", "lo", "hi"], 60_000):
            starts = run_starts(t, ["key", "lo", "hi"])
            many = np.diff(np.append(starts, len(t)))
            of = np.repeat(np.arange(len(starts)), many)
            use = np.flatnonzero(np.repeat(many, many) > 1)
            if not len(use):
                continue
            f = t.column("fp").to_numpy()[use]
            i, j = close_pairs(f.view(np.uint64), of[use], radius)
            nodes, here = np.unique(f, return_inverse=True)
            low = tree(len(nodes), here[i], here[j])
            moved = np.flatnonzero(low != np.arange(len(nodes)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[low[moved]])], names=["a", "b"])
    return run


def _keys(blocks: int, radius: int):
    """SQL of the array of keys: a number of the chosen blocks in the top bits and the blocks' bits below, hashed."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(edges, edges[1:])]
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    return F.expr("array(" + ", ".join(f"xxhash64({n}, " + ", ".join(part[k] for k in c) + ")" for n, c in enumerate(chosen)) + ")")


def blocks_for(n: int, radius: int) -> int:
    """Least number of blocks at which a key has about 64 of ``n`` evenly spread fingerprints or fewer."""
    b = radius + 1
    while b < 2 * radius and n > 64 * 2 ** (64 * (b - radius) // b):
        b += 1
    return b


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc: str = "doc_id", text: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable): one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; equal
    fingerprints are one node; rows of equal id are rows of their own; null ids never
    are a component's least unless it has no other.
    """
    rows = cut(fingerprints(docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", width, seed))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    b = blocks_for(prints.count(), radius)
    keyed = prints.select("fp", F.explode(_keys(b, radius)).alias("key"))
    links = (spread(keyed, "key", F.col("fp"), BLOCK).select("key", "lo", "hi", "fp")
             .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
             .mapInArrow(_links(radius), "a bigint, b bigint"))
    comp = components(links)
    root = comp.join(prints, comp.node == prints.fp).groupBy("component").agg(F.min("least").alias("root"))
    joined = comp.join(root, "component").select(F.col("node").alias("fp"), "root")
    told = prints.join(joined, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return rows.join(told, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more); columns unchanged.

    Rows are told apart by id and text: the one of least (id, hash of the text) stays,
    a null id only where the group has no other.  Of rows equal in both, any one.
    """
    near = near_copies(docs, doc=doc, text=text, **how)
    own = F.col(doc).cast("bigint")
    key = {"no_id": own.isNull(), "id": F.coalesce(own, F.lit(0)), "th": F.xxhash64(text)}
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th"))
    least = near.groupBy("component").agg(first.alias("m")).select("m.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in key.items()])
    return rows.join(least, list(key), "left_semi").dropDuplicates(list(key)).select("row.*")
