"""Exact top-k search by inner product with a pivot table.

Vectors become integers, floor(64 x).  Every vector's distances to many pivots are
computed once; for a query q and a row x the largest difference of those distances
is a lower bound of |q - x|, hence (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound
of their inner product.  A query looks at rows in the order of that bound and stops
when the next bound is below its k-th score.  Rows and queries meet block by block;
what leaves a pair of blocks is at most k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import one_thread
from panelwright.session import cut

SCALE = 64
BLOCK = 4096
STEP = 256
ROWS = "vec_id bigint, dim int, norm bigint, v binary"


def integer_vectors(df: DataFrame, row: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim, norm and v (little-endian int32 components floor(scale x)).

    Left out: rows without an id, null and empty vectors, vectors with null or non-finite components, and
    those with a component beyond 2^31 or a squared norm from 2^61 on, whose scores
    would not fit a long.
    """
    def run(batches):
        for b in batches:
            lists = b.column("x")
            ids, keep, dims, norms, out = b.column("vec_id"), [], [], [], []
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, ok in enumerate(lists.is_valid().to_pylist()):
                x = np.floor(scale * flat[at[i]: at[i + 1]].astype(np.float64))
                if ok and len(x) and np.isfinite(x).all() and np.abs(x).max() < 2 ** 31 and x @ x < 2 ** 61:
                    z = x.astype(np.int64)
                    keep.append(i), dims.append(len(z)), norms.append(int(z @ z)), out.append(z.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()),
                                              pa.array(norms, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "dim", "norm", "v"])
    x = df.select(F.col(row).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return x.filter("vec_id IS NOT NULL").mapInArrow(run, ROWS)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots): exact squared distances in integers, then their roots."""
    big = x.astype(np.int64)
    p = pivots.astype(np.int64)
    return np.sqrt(np.stack([((big - q) ** 2).sum(1) for q in p], 1).astype(np.float64))


def _best(qx, qn, qd, qid, cx, cn, cd, cid, k: int):
    """Per query the k best of a block: (query number, row number, score) arrays.

    The float bounds are widened by more than their rounding, so a row is passed over
    only if its exact score is below k scores already found.
    """
    exact = max(float(qn.max()), float(cn.max())) < 2 ** 52
    kind = np.float64 if exact else np.int64
    bound = np.zeros((len(qx), len(cx)))
    for p in range(cd.shape[1]):
        np.maximum(bound, np.abs(qd[:, p, None] - cd[None, :, p]), out=bound)
    half = (qn[:, None].astype(np.float64) + cn[None, :]) / 2
    bound = half - np.square(bound) / 2 + half * 1e-12 + 1e-3
    order = np.argsort(-bound, axis=1)
    bound = np.take_along_axis(bound, order, 1)
    out, ids, cxk, qxk = [], cid, cx.astype(kind), qx.astype(kind)
    live = np.arange(len(qx))
    best = np.full((len(qx), k), -1, np.int64)
    score = np.full((len(qx), k), np.iinfo(np.int64).min, np.int64)
    for lo in range(0, len(cx), STEP):
        live = live[(score[live, -1] <= bound[live, lo]) | (best[live, -1] < 0)]
        if not len(live):
            break
        at = order[live, lo: lo + STEP]
        got = np.matmul(cxk[at], qxk[live][:, :, None])[:, :, 0].astype(np.int64)
        own = ids[at] == qid[live, None]
        at = np.where(own, -1, at)
        got = np.where(own, np.iinfo(np.int64).min, got)
        at, got = np.concatenate([best[live], at], 1), np.concatenate([score[live], got], 1)
        rank = np.lexsort((np.where(at >= 0, ids[at], np.iinfo(np.int64).max), -np.maximum(got, -2 ** 62)), axis=1)[:, :k]
        best[live], score[live] = np.take_along_axis(at, rank, 1), np.take_along_axis(got, rank, 1)
    q, r = np.nonzero(best >= 0)
    return q, best[q, r], score[q, r]


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 24, block: int = BLOCK, seed: int = 11,
          row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query, ties to the smaller id.

    Queries and rows are compared within equal dimensions.  A row with the query's
    id is never its answer; repeated ids among the rows are answers of their own, and
    of queries of one id the one of least (dimension, norm, bytes) is asked.
    Fewer than k rows give fewer answers; no rows give none.
    """
    rows = cut(integer_vectors(df, row, vector))
    asks = (integer_vectors(queries, row, vector).groupBy("vec_id").agg(F.min(F.struct("dim", "norm", "v")).alias("s"))
            .select("vec_id", "s.*"))
    h = F.xxhash64(F.lit(seed), "vec_id", "v")
    chosen = (rows.groupBy("dim", F.pmod(h, F.lit(pivots)).alias("slot")).agg(F.min_by("v", F.struct(h, "v")).alias("v"))).collect()
    table = {d: _matrix([bytes(r.v) for r in sorted((x for x in chosen if x.dim == d), key=lambda r: r.slot)]) for d in {r.dim for r in chosen}}
    shared = df.sparkSession.sparkContext.broadcast(table)
    n, m = rows.count(), asks.count()
    cb, qb = max(1, math.ceil(n / block)), max(1, math.ceil(m / block))

    def placed(d, own, other, n_own, n_other):
        return (d.withColumn(own, F.pmod(h, F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    def with_distances(d):
        def run(batches):
            one_thread()
            for b in batches:
                dims = b.column("dim").to_numpy()
                out = [b""] * len(dims)
                for dim in np.unique(dims):
                    if dim not in shared.value:
                        continue
                    at = np.flatnonzero(dims == dim)
                    dist = _distances(_matrix(b.column("v").take(pa.array(at)).to_pylist()), shared.value[dim])
                    for i, x in zip(at.tolist(), dist):
                        out[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "dist"])
        return d.mapInArrow(run, ROWS + ", dist binary")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        one_thread()
        got = [[], [], []]
        if len(left) and len(right):
            def parts(t):
                x = _matrix(t.column("v").to_pylist())
                return (x, t.column("norm").to_numpy(), np.frombuffer(b"".join(t.column("dist").to_pylist())).reshape(len(x), -1),
                        t.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy())
            cx, cn, cd, cid = parts(left)
            qx, qn, qd, qid = parts(right)
            for lo in range(0, len(qx), 128):
                s = slice(lo, lo + 128)
                q, c, score = _best(qx[s], qn[s], qd[s], qid[s], cx, cn, cd, cid, k)
                for g, x in zip(got, (qid[s][q], cid[c], score)):
                    g.append(x)
        cols = [np.concatenate(g) if g else np.empty(0, np.int64) for g in got]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    left = placed(with_distances(rows), "cb", "qb", cb, qb).groupBy("dim", "cb", "qb")
    right = placed(with_distances(asks), "qb", "cb", qb, cb).groupBy("dim", "cb", "qb")
    found = left.cogroup(right).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
