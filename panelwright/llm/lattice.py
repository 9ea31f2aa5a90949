"""Near-duplicate embeddings by lattice hashing.

A unit vector is projected to eight dimensions in several tables and decoded to the
nearest point of the lattice E8.  It is stored under that point and also visits the
next nearest of the point's 240 neighbours; vectors of a label that share a cell, one
of them at home there, are compared by cosine in double precision.  Cells with many
vectors are dealt to pairs of blocks.  What leaves a cell is one link a vector at
most (to the least vector it is joined with), so a dense group costs no more than a
sparse one to pass on.  Links are counted in a second pass within each component,
block against block, so every pair is counted once however many cells it shared.

Rows with equal label and vector are one node throughout and come back at the end.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, one_thread, run_starts, spread, tree, whole_runs
from panelwright.session import cut

TABLES, PROBES, SCALE, SEED = 6, 2, 0.2, 17
BLOCK = 2048


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    whole = [a * np.eye(8)[i] + b * np.eye(8)[j] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(whole + half)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the nearer of the best even-sum integer point and the best one shifted by half."""
    def even(z):
        p = np.rint(z)
        odd = np.flatnonzero(p.sum(1) % 2 != 0)
        off = z[odd] - p[odd]
        worst = np.abs(off).argmax(1)
        p[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return p
    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((np.square(x - a).sum(1) <= np.square(x - b).sum(1))[:, None], a, b)


def cells(units: np.ndarray, table: int, radius: float, probes: int) -> np.ndarray:
    """(rows, 1 + probes): numbers of the home cell and of the cells visited, for one table.

    ``radius`` is the distance of vectors at the threshold; the projection is scaled to it.
    """
    dim = units.shape[1]
    turn = np.random.default_rng([SEED, table, dim]).normal(size=(dim, 8)) * (SCALE / radius)
    x = units @ turn
    home = nearest_point(x)
    steps = _neighbours()
    next_ = np.argsort(-((x - home) @ steps.T), axis=1, kind="stable")[:, :probes]
    points = np.concatenate([home[:, None], home[:, None] + steps[next_]], 1)
    words = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    h = np.full(points.shape[:2], table * 1000 + dim, np.uint64)
    for k in range(8):
        h = (h ^ words[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def _units(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(df: DataFrame, row: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v: v holds the components as doubles, null for vectors that link with nothing."""
    def run(batches):
        for b in batches:
            lists = b.column("x")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out = []
            for i, ok in enumerate(lists.is_valid().to_pylist()):
                x = flat[at[i]: at[i + 1]] + 0.0
                with np.errstate(over="ignore"):
                    fit = ok and len(x) and np.isfinite(x).all() and np.isfinite(x @ x) and (x @ x) > 0
                out.append(x.tobytes() if fit else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])
    x = df.select(F.col(row).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return x.mapInArrow(run, "vec_id bigint, label string, v binary").withColumn("v", F.when(F.col("label").isNotNull(), F.col("v")))


def _cell_links(threshold: float):
    def run(batches):
        one_thread()
        for t in whole_runs(batches, ["cell", "lo", "hi"], 20_000):
            starts = run_starts(t, ["cell", "lo", "hi"])
            ends = np.append(starts[1:], len(t))
            ids, home = t.column("node").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
            v = t.column("v").combine_chunks()
            a, b = [], []
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                x = _units(v.slice(lo, hi - lo).to_pylist())
                at = np.flatnonzero(home[lo:hi])
                p, q = np.nonzero(x[at] @ x.T >= threshold)
                n, here = np.unique(ids[lo:hi], return_inverse=True)
                p, q = here[at[p]], here[q]
                low = tree(len(n), p[p != q], q[p != q])
                moved = np.flatnonzero(low != np.arange(len(n)))
                a.append(n[moved]), b.append(n[low[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def _count_links(threshold: float):
    def run(batches):
        one_thread()
        for t in whole_runs(batches, ["component", "lo", "hi"], 20_000):
            starts = run_starts(t, ["component", "lo", "hi"])
            ends = np.append(starts[1:], len(t))
            ids, own, many = (t.column(c).to_numpy() for c in ("node", "own", "many"))
            lo_, hi_ = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            v, n_links = t.column("v").combine_chunks(), np.zeros(len(t), np.int64)
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                x, s = _units(v.slice(lo, hi - lo).to_pylist()), slice(lo, hi)
                near = x @ x.T >= threshold
                near &= ~np.eye(hi - lo, dtype=bool)
                if lo_[lo] != hi_[lo]:
                    near &= own[s, None] != own[None, s]
                n_links[s] = near @ many[s]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_links)], names=["node", "links"])
    return run


def near_duplicates(df: DataFrame, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES,
                    row: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``df``.

    Linked are rows of equal, non-null label and equal dimension whose cosine is at least
    ``threshold``, found by a shared cell.  Null, empty and zero vectors, those with null
    or non-finite components and those without a label link with nothing (their own
    component, kept).  Rows of equal id count as rows of their own.
    """
    all_rows = cut(nodes(df, row, vector, label))
    groups = all_rows.filter("v IS NOT NULL").groupBy("label", "v").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("many"), F.min(F.xxhash64("label", "v")).alias("node"))
    groups = cut(groups)
    radius = float(np.sqrt(2 - 2 * threshold))

    def place(batches):
        one_thread()
        for b in batches:
            blobs = b.column("v").to_pylist()
            sizes = np.array([len(x) for x in blobs])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                units = _units([blobs[i] for i in at])
                part = b.take(pa.array(at))
                for t in range(tables):
                    c = cells(units, t, radius, probes)
                    for k in range(c.shape[1]):
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c[:, k]), pa.array(np.full(len(at), k == 0))],
                                                         names=["node", "label", "v", "cell", "home"])
    placed = (groups.select("node", "label", "v").mapInArrow(place, "node bigint, label string, v binary, cell bigint, home boolean")
              .withColumn("cell", F.xxhash64("cell", "label")).drop("label"))
    links = (spread(placed, "cell", F.col("node"), BLOCK).select("cell", "lo", "hi", "node", "home", "v")
             .repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
             .mapInArrow(_cell_links(threshold), "a bigint, b bigint"))
    comp = components(links)
    members = comp.join(groups, "node").select("component", "node", "v", "many", "least")
    counts = (spread(members, "component", F.col("node"), BLOCK).select("component", "lo", "hi", "own", "node", "many", "v")
              .repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
              .mapInArrow(_count_links(threshold), "node bigint, links bigint")
              .groupBy("node").agg(F.sum("links").alias("links")))
    least = comp.join(groups.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("root"))
    told = (groups.join(comp, "node", "left").join(counts, "node", "left").join(least, "component", "left")
            .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "least").alias("root")))
    return (all_rows.join(told, ["label", "v"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
