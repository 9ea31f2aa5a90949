"""Street-network measures on edge tables, for many networks at once.

Edges are (net, src, dst, key, length, travel_time).  Iterative operators keep
their frontier as a small table, cut its lineage every round and stop at the
fixed point; each round is an equi-join on (net, node) and a grouped
reduction, so a network of any size is spread over the cluster.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ranks import dense_index, ordered_index, with_group
from panelwright.operators.tables import dedupe_undirected, shortest_undirected
from panelwright.session import cut, let_go


def _unfinished(rounds: int):
    return RuntimeError(f"not settled after {rounds} rounds; raise max_rounds")


def street_segments(edges: DataFrame, nodes: DataFrame, core: tuple | None = None) -> DataFrame:
    """Undirected faces with midpoints; only those whose midpoint is in the core box are kept."""
    s = dedupe_undirected(edges, ["net"])
    at = lambda end: nodes.select("net", F.col("node").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    s = s.join(at("lo"), ["net", "lo"]).join(at("hi"), ["net", "hi"])
    s = s.withColumns({"mid_x": (F.col("lo_x") + F.col("hi_x")) / 2, "mid_y": (F.col("lo_y") + F.col("hi_y")) / 2})
    if core:
        x0, y0, x1, y1 = core
        s = s.where(F.col("mid_x").between(x0, x1) & F.col("mid_y").between(y0, y1))
    return s.drop("lo_x", "lo_y", "hi_x", "hi_y")


def both_ways(und: DataFrame) -> DataFrame:
    """Undirected (net, lo, hi, length) as arcs (net, u, v, length)."""
    return und.select("net", F.col("lo").alias("u"), F.col("hi").alias("v"), "length").unionByName(
        und.select("net", F.col("hi").alias("u"), F.col("lo").alias("v"), "length"))


def node_degree(edges: DataFrame) -> DataFrame:
    return both_ways(shortest_undirected(edges, ["net"])).groupBy("net", F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def intersections(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes where three or more streets meet: street_count where mapped, else the degree."""
    d = nodes.join(node_degree(edges), ["net", "node"], "left")
    n = F.coalesce(F.col("street_count") if "street_count" in nodes.columns else F.lit(None), "degree", F.lit(0))
    return d.where(n >= least)


def boundary_nodes(nodes: DataFrame, tol: float = 100.0, box: tuple | None = None) -> DataFrame:
    """Nodes within ``tol`` of the padded box's outline (a network's own extent by default)."""
    if box:
        d = nodes.withColumns({k: F.lit(float(v)) for k, v in zip(("_x0", "_y0", "_x1", "_y1"), box)})
    else:
        d = with_group(nodes, ["net"], _x0=F.min("x"), _y0=F.min("y"), _x1=F.max("x"), _y1=F.max("y"))
    out = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    inside = F.least(F.col("x") - F.col("_x0"), F.col("_x1") - F.col("x"), F.col("y") - F.col("_y0"), F.col("_y1") - F.col("y"))
    dx, dy = out("x", "_x0", "_x1"), out("y", "_y0", "_y1")
    d = d.withColumn("_d", F.when((dx > 0) | (dy > 0), F.hypot(dx, dy)).otherwise(inside))
    return d.where(F.col("_d") < tol).select("net", "node")


def dead_ends(edges: DataFrame, frozen: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Per undirected pair: ``is_deadend`` (touches a leaf) and ``cul_de_sac`` (falls off when
    degree-1 nodes are stripped again and again).  Frozen nodes are never stripped."""
    und = cut(shortest_undirected(edges, ["net"]).select("net", "lo", "hi", "length"))
    fz = frozen.select("net", "node").distinct()
    k = ["net", "node"]

    def leaves(e):
        ends = both_ways(e).groupBy("net", F.col("u").alias("node")).agg(F.count("*").alias("deg"))
        return ends.where("deg = 1").join(fz, k, "left_anti").select("net", "node")

    first = cut(leaves(und))
    alive, gone, tips = und, [], first
    for _ in range(max_rounds):
        touch = lambda e, end: e.join(tips.withColumnRenamed("node", end), ["net", end], "left_semi")
        hit = touch(alive, "lo").unionByName(touch(alive, "hi")).select("net", "lo", "hi").distinct()
        hit = cut(hit)
        if hit.isEmpty():
            break
        gone.append(hit)
        alive = cut(alive.join(hit, ["net", "lo", "hi"], "left_anti"))
        tips = leaves(alive)
    else:
        raise _unfinished(max_rounds)
    pruned = reduce(lambda a, b: a.unionByName(b), gone) if gone else und.select("net", "lo", "hi").limit(0)
    leaf = first.withColumn("_leaf", F.lit(True))
    d = (und.join(leaf.select("net", F.col("node").alias("lo"), F.col("_leaf").alias("_a")), ["net", "lo"], "left")
            .join(leaf.select("net", F.col("node").alias("hi"), F.col("_leaf").alias("_b")), ["net", "hi"], "left")
            .join(pruned.withColumn("_p", F.lit(True)), ["net", "lo", "hi"], "left"))
    return d.select("net", "lo", "hi", F.coalesce("_a", "_b", F.lit(False)).alias("is_deadend"), F.coalesce("_p", F.lit(False)).alias("cul_de_sac"))


def reachable(arcs: DataFrame, sources: DataFrame, radius: float, max_rounds: int = 10_000) -> DataFrame:
    """Network distances up to ``radius`` from every source: (net, source, node, dist).

    Only nodes whose distance fell in the last round send messages.
    """
    k = ["net", "source", "node"]
    best = cut(sources.select("net", F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")))
    moving = best
    for _ in range(max_rounds):
        step = moving.join(arcs.select("net", F.col("u").alias("node"), "v", "length"), ["net", "node"])
        step = step.select("net", "source", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("nd")).where(F.col("nd") <= radius)
        step = step.groupBy(*k).agg(F.min("nd").alias("nd"))
        better = cut(step.join(best, k, "left").where(F.col("dist").isNull() | (F.col("nd") < F.col("dist"))).select(*k, F.col("nd").alias("dist")))
        if better.isEmpty():
            break
        best = cut(best.join(better.select(*k), k, "left_anti").unionByName(better))
        moving = better
    else:
        raise _unfinished(max_rounds)
    return best


def egress_count(edges: DataFrame, radius: float = 200.0) -> DataFrame:
    """Distinct frontier nodes (in reach, with a neighbour beyond) seen from either end of each pair."""
    und = cut(shortest_undirected(edges, ["net"]))
    arcs = cut(both_ways(und))
    src = arcs.select("net", F.col("u").alias("node")).distinct()
    seen = reachable(arcs, src, radius)
    out = seen.select("net", "source", "node").join(arcs.select("net", F.col("u").alias("node"), "v"), ["net", "node"])
    inside = seen.select("net", "source", F.col("node").alias("v"))
    front = cut(out.join(inside, ["net", "source", "v"], "left_anti").select("net", "source", "node").distinct())
    at = lambda end: und.select("net", "lo", "hi").join(front.withColumnRenamed("source", end), ["net", end]).select("net", "lo", "hi", "node")
    both = at("lo").unionByName(at("hi")).distinct().groupBy("net", "lo", "hi").agg(F.count("*").alias("egress_count"))
    return und.select("net", "lo", "hi").join(both, ["net", "lo", "hi"], "left").withColumn("egress_count", F.coalesce("egress_count", F.lit(0)))


def pick_pivots(nodes: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """All nodes, or ``k`` hash-drawn ones a network; ``scale`` corrects for the sampling (1 where exact)."""
    d = nodes.select("net", "node")
    if k is None:
        return d.distinct().withColumn("scale", F.lit(1.0))
    d = with_group(dense_index(d, ["net"], F.xxhash64(F.lit(seed), "net", "node"), "_i"), ["net"], _n=F.count("*"))
    want = F.least(F.lit(k), F.col("_n"))
    return d.where(F.col("_i") < want).select("net", "node", (F.col("_n") / want).alias("scale"))


BLOCK = 64                      # sources whose values ride in one row
REGION = 256                    # neighbouring nodes that settle among themselves before they send anything on
NEAR_SOURCES = 256              # neighbouring sources that are worked on together where they do not reach far
NEAR_NODES = 1 << 14            # nodes, and arcs, that such sources reach at most
NEAR_ARCS = 1 << 17
PAIRS_AT_ONCE = 1 << 19         # of a source and a node
BLOCKS_AT_ONCE = 1024           # of sources, in one region
FAR_ROWS = 1 << 20              # nodes x blocks of sources that reach far, at once
_KEY = ["net", "metric", "blk", "node"]
_GROUP = ["net", "metric", "blk", "reg"]
_STATE = "net {net}, metric int, blk bigint, reg bigint, node {node}, d array<double>, acc array<double>, inc array<double>, live boolean"


def _rows(lists) -> np.ndarray:
    return pa.concat_arrays(lists.chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _arrays(m: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _by_end(ends: np.ndarray, values: np.ndarray, how) -> tuple[np.ndarray, np.ndarray]:
    """The different ``ends`` (given in order) and ``how`` over the rows of each."""
    first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    return ends[first], how.reduceat(values, first, axis=0)


def _fall(d, at, sent, w, a, b, wab) -> np.ndarray:
    """Distances fall by the messages (``sent`` + ``w`` to ``at``), then along the arcs a-b until they are still; nodes that changed."""
    fresh = np.zeros(len(d), bool)
    ends, low = _by_end(at, sent + w[:, None], np.minimum)
    while True:
        moved = np.zeros(len(d), bool)
        moved[ends] = (low < d[ends]).any(axis=1)
        d[ends] = np.minimum(d[ends], low)
        fresh |= moved
        use = moved[a]
        if not use.any():
            return fresh
        ends, low = _by_end(b[use], d[a[use]] + wab[use][:, None], np.minimum)


def _add(d, at, sent, w, inc, a, b, wab, back: bool) -> np.ndarray:
    """What each node newly receives: by the messages along tight arcs, then from each other along tight arcs a-b."""
    tight = lambda from_, to, w: np.isfinite(from_) & ((to + w[:, None] == from_) if back else (from_ + w[:, None] == to))
    ends, got = _by_end(at, np.where(tight(sent, d[at], w), inc, 0.0), np.add)
    of = tight(d[a], d[b], wab)
    total = np.zeros_like(d)
    while got.any():
        now = np.zeros_like(d)
        now[ends] = got
        total += now
        use = (now != 0).any(axis=1)[a]
        if not use.any():
            break
        ends, got = _by_end(b[use], np.where(of[use], now[a[use]], 0.0), np.add)
    return total


def _settle(kind: str):
    """One region under one block of sources takes in its messages.

    Rows: own values (``w`` null), messages (``w`` given), arcs inside the region (``v`` given).
    """
    def run(t: pa.Table) -> pa.Table:
        node, w = t.column("node").to_numpy(), t.column("w").to_numpy()
        arc = t.column("v").is_valid().to_numpy()
        own = ~arc & t.column("w").is_null().to_numpy()
        v = t.filter(pa.array(arc)).column("v").to_numpy()
        held = t.filter(pa.array(own))
        msg = np.flatnonzero(~arc & ~own)
        msg = msg[np.argsort(node[msg], kind="stable")]
        ids = np.unique(np.concatenate([node, v]))
        at, mine = np.searchsorted(ids, node[msg]), np.searchsorted(ids, node[own])
        a, b, wab = np.searchsorted(ids, node[arc]), np.searchsorted(ids, v), w[arc]
        order = np.argsort(b, kind="stable")
        a, b, wab = a[order], b[order], wab[order]
        came = t.take(pa.array(msg))
        sent = _rows(came.column("d"))
        d = np.full((len(ids), sent.shape[1]), np.inf)
        if len(mine):
            d[mine] = _rows(held.column("d"))
        if kind == "distance":
            live, more = _fall(d, at, sent, w[msg], a, b, wab), None
        else:
            inc = _add(d, at, sent, w[msg], _rows(came.column("inc")), a, b, wab, kind == "back")
            acc = inc.copy()
            if len(mine):
                acc[mine] += _rows(held.column("acc"))
            live, more = (inc != 0).any(axis=1), (acc, inc)
        keep = np.isfinite(d).any(axis=1)
        n = int(keep.sum())
        lists = [pa.nulls(n, pa.list_(pa.float64()))] * 2 if more is None else [_arrays(m[keep]) for m in more]
        return pa.Table.from_arrays(
            [*[pa.repeat(t.column(c)[0], n) for c in _GROUP], pa.array(ids[keep], t.schema.field("node").type), _arrays(d[keep]), *lists, pa.array(live[keep])],
            names=[*_GROUP, "node", "d", "acc", "inc", "live"])
    return run


def _until_still(arcs: DataFrame, state: DataFrame | None, sent: DataFrame, kind: str, schema: str, max_rounds: int) -> DataFrame:
    """``state`` after the messages ``sent`` and all that follow from them.

    ``arcs``: (net, metric, node, reg, v, to, w), ``to`` being the region of v.  Only regions that get messages are worked on.
    """
    inner, border = arcs.where("reg = to"), arcs.where("reg <> to").select("net", "metric", "node", F.col("to").alias("_to"), "v", "w")
    none = lambda t: F.lit(None).cast(t)
    node, lists = dict(arcs.dtypes)["node"], "array<double>"
    order = [*_GROUP, "node", "v", "w", "d", "acc", "inc"]
    for _ in range(max_rounds):
        hot = sent.select(*_GROUP).distinct()
        rows = sent.select(*_GROUP, "node", none(node).alias("v"), "w", "d", none(lists).alias("acc"), "inc").unionByName(
            hot.join(inner, ["net", "metric", "reg"]).select(*_GROUP, "node", "v", "w", *[none(lists).alias(c) for c in ("d", "acc", "inc")]))
        if state is not None:
            rows = rows.unionByName(state.join(hot, _GROUP, "left_semi").select(
                *_GROUP, "node", none(node).alias("v"), none("double").alias("w"), "d", "acc", none(lists).alias("inc")))
        new = rows.select(*order).groupBy(*_GROUP).applyInArrow(_settle(kind), schema)
        if state is not None:
            new = new.unionByName(state.join(hot, _GROUP, "left_anti").withColumn("live", F.lit(False)))
        state = cut(new)
        sent = cut(state.where("live").join(border, ["net", "metric", "node"]).select(
            "net", "metric", "blk", F.col("_to").alias("reg"), F.col("v").alias("node"), "w", "d", "inc"))
        if sent.isEmpty():
            return state
        let_go(arcs.sparkSession)
    raise _unfinished(max_rounds)


def _spread(t: pa.Table) -> pa.Table:
    """What blocks of sources newly reach in one region, and the nodes of other regions that follow from it.

    Rows: arcs out of the region (``v`` given), nodes a block has reached here (``fresh``) or is to reach (not ``fresh``).
    """
    arc = t.column("v").is_valid().to_numpy()
    kind, reg = t.schema.field("node").type, t.column("reg")[0].as_py()
    arcs, lists = t.filter(pa.array(arc)), t.filter(pa.array(~arc))
    a, v, inside = arcs.column("node").to_numpy(), arcs.column("v").to_numpy(), arcs.column("to").to_numpy() == reg
    nodes = lists.column("nodes").combine_chunks()
    flat = nodes.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(nodes.offsets.to_numpy()))
    ids = np.unique(np.concatenate([a, v[inside], flat]))
    blks, of = np.unique(lists.column("blk").to_numpy(), return_inverse=True)
    old = lists.column("fresh").to_numpy(zero_copy_only=False)[row]
    was, front = np.zeros((len(ids), len(blks)), bool), np.zeros((len(ids), len(blks)), bool)
    at = np.searchsorted(ids, flat)
    was[at[old], of[row[old]]] = True
    front[at[~old], of[row[~old]]] = True
    front &= ~was
    seen = was | front
    pa_, pb = np.searchsorted(ids, a[inside]), np.searchsorted(ids, v[inside])
    order = np.argsort(pb, kind="stable")
    pa_, pb = pa_[order], pb[order]
    while len(pb) and front.any():
        ends, come = _by_end(pb, front[pa_], np.logical_or)
        front = np.zeros_like(seen)
        front[ends] = come & ~seen[ends]
        seen |= front
    new = seen & ~was
    degree = np.bincount(np.searchsorted(ids, a), minlength=len(ids))

    def packed(blk, of_reg, node, fresh, count):
        """One row for each (blk, reg), which come in order."""
        first = np.flatnonzero(np.append(True, (blk[1:] != blk[:-1]) | (of_reg[1:] != of_reg[:-1]))) if len(blk) else np.zeros(0, int)
        n = len(first)
        values = pa.ListArray.from_arrays(pa.array(np.append(first, len(blk)).astype(np.int32)), pa.array(node, kind))
        return pa.Table.from_arrays([pa.repeat(t.column("net")[0], n), pa.array(blks[blk[first]]), pa.array(of_reg[first], pa.int64()), values, pa.array(np.full(n, fresh)),
                                     pa.array(np.add.reduceat(count, first) if n else np.zeros(0), pa.int64())], names=["net", "blk", "reg", "nodes", "fresh", "arcs"])
    b, n = np.nonzero(new.T)
    here = packed(b, np.full(len(b), reg), ids[n], True, degree[n])
    out_a, out_v, out_to = np.searchsorted(ids, a[~inside]), v[~inside], arcs.column("to").to_numpy()[~inside]
    order = np.lexsort((out_v, out_to))
    out_a, out_v, out_to = out_a[order], out_v[order], out_to[order]
    b, n = np.nonzero(new[out_a].T)
    keep = np.append(True, (b[1:] != b[:-1]) | (out_v[n][1:] != out_v[n][:-1]))[: len(b)]
    b, n = b[keep], n[keep]
    return pa.concat_tables([here, packed(b, out_to[n], out_v[n], False, np.zeros(len(b), np.int64))])


def _reached(streets: DataFrame, src: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(net, blk, nodes) that blocks of sources reach, and the blocks (net, blk) that reach more than NEAR_NODES, NEAR_ARCS.

    ``streets``: (net, node, reg, v, to).  A region settles within; a block that reaches far goes no further.
    """
    types, spark = dict(streets.dtypes), streets.sparkSession
    schema = f"net {types['net']}, blk bigint, reg bigint, nodes array<{types['node']}>, fresh boolean, arcs bigint"
    none = lambda t: F.lit(None).cast(t)
    cols = ["net", "reg", "part", "blk", "node", "v", "to", "nodes", "fresh"]
    part = F.floor(F.col("blk") / BLOCKS_AT_ONCE).alias("part")
    lists = lambda d: d.select("net", "reg", part, "blk", none(types["node"]).alias("node"), none(types["node"]).alias("v"), none("bigint").alias("to"), "nodes", "fresh")
    sent = cut(src.groupBy("net", "blk", "reg").agg(F.collect_list("node").alias("nodes")).withColumn("fresh", F.lit(False)))
    state, far = None, None
    for _ in range(max_rounds):
        hot = sent.select("net", "reg", "blk").distinct()
        here = hot.select("net", "reg", part).distinct().join(streets, ["net", "reg"])
        rows = lists(sent).unionByName(here.select("net", "reg", "part", none("bigint").alias("blk"), "node", "v", "to", none(f"array<{types['node']}>").alias("nodes"), none("boolean").alias("fresh")))
        if state is not None:
            rows = rows.unionByName(lists(state.join(hot, ["net", "reg", "blk"], "left_semi").select("net", "reg", "blk", "nodes", "fresh")))
        got = cut(rows.select(*cols).groupBy("net", "reg", "part").applyInArrow(_spread, schema))
        state = got.where("fresh") if state is None else state.unionByName(got.where("fresh"))
        size = state.groupBy("net", "blk").agg(F.sum(F.size("nodes")).alias("_n"), F.sum("arcs").alias("_a"))
        far = cut(size.where((F.col("_n") > NEAR_NODES) | (F.col("_a") > NEAR_ARCS)).select("net", "blk"))
        sent = cut(got.where("not fresh").select("net", "blk", "reg", "nodes", "fresh").join(far, ["net", "blk"], "left_anti"))
        if sent.isEmpty():
            return state.select("net", "blk", "nodes").join(far, ["net", "blk"], "left_anti"), far
    raise _unfinished(max_rounds)


def _out_of(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at`` of a table of neighbours: which of them, and the neighbour's number, for all their neighbours."""
    lo = first[at]
    many = first[at + 1] - lo
    of = np.repeat(np.arange(len(at)), many)
    return of, np.arange(len(of)) + np.repeat(lo - np.cumsum(many) + many, many)


def _carried(src: np.ndarray, n: int, first: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over the sources ``src`` of what each arc carries: the near end's paths times the far end's sum of (1 + dependency) / paths."""
    pairs = len(src) * n                                # a source's place and a node, as one number
    start = np.arange(len(src)) * n + src
    mark = np.zeros(pairs, np.int64)

    def once(p):
        mark[p] = np.arange(len(p))
        return p[mark[p] == np.arange(len(p))]
    d = np.full(pairs, np.inf)
    d[start] = 0.0
    front = start
    while len(front):
        node = front % n
        of, arc = _out_of(first, node)
        to, far = (front - node)[of] + b[arc], d[front][of] + w[arc]
        less = far < d[to]
        to = to[less]
        np.minimum.at(d, to, far[less])
        front = once(to)
    near = np.flatnonzero(np.isfinite(d))
    node = near % n
    of, arc = _out_of(first, node)
    to, near = (near - node)[of] + b[arc], near[of]
    tight = d[near] + w[arc] == d[to]
    near, to, arc = near[tight], to[tight], arc[tight]
    follow = np.append(0, np.cumsum(np.bincount(near, minlength=pairs)))
    left = np.bincount(to, minlength=pairs)
    paths = np.zeros(pairs)
    paths[start] = 1.0
    front, waves = start, []
    while len(front):
        step = _out_of(follow, front)[1]
        ends = to[step]
        np.add.at(paths, ends, paths[near[step]])
        np.subtract.at(left, ends, 1)
        waves.append(step)
        front = once(ends[left[ends] == 0])
    x = np.divide(1.0, paths, out=np.zeros(pairs), where=paths > 0)
    for step in reversed(waves):
        np.add.at(x, near[step], x[to[step]])
    return np.bincount(arc, paths[near] * x[to], minlength=len(b))


def _shares_of(metrics: int):
    """Of one block of sources and the arcs it reaches: what each arc carries by each weight."""
    def run(t: pa.Table) -> pa.Table:
        arc = t.column("v").is_valid().to_numpy()
        arcs = t.filter(pa.array(arc))
        a, v, src = arcs.column("node").to_numpy(), arcs.column("v").to_numpy(), t.filter(pa.array(~arc)).column("node").to_numpy()
        ids = np.unique(np.concatenate([a, v, src]))
        src, n, out = np.searchsorted(ids, src), len(ids), []
        for i in range(metrics):
            has = arcs.column(f"w{i}").is_valid().to_numpy()
            pa_, pb, w = np.searchsorted(ids, a[has]), np.searchsorted(ids, v[has]), arcs.column(f"w{i}").to_numpy()[has]
            order = np.lexsort((pb, pa_))
            pa_, pb, w = pa_[order], pb[order], w[order]
            first = np.searchsorted(pa_, np.arange(n + 1))
            f, step = np.zeros(len(w)), max(1, PAIRS_AT_ONCE // n)
            for lo in range(0, len(src), step):
                f += _carried(src[lo: lo + step], n, first, pb, w)
            some = np.flatnonzero(f)
            kind = t.schema.field("node").type
            out.append(pa.Table.from_arrays([pa.repeat(t.column("net")[0], len(some)), pa.array(np.full(len(some), i, np.int32)), pa.array(ids[np.minimum(pa_, pb)[some]], kind),
                                             pa.array(ids[np.maximum(pa_, pb)[some]], kind), pa.array(f[some])], names=["net", "metric", "lo", "hi", "f"]))
        return pa.concat_tables(out)
    return run


def _near_shares(arcs: DataFrame, src: DataFrame, metrics: int, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(net, metric, lo, hi, f) carried from blocks of sources that do not reach far, and the other blocks (net, blk)."""
    reached, far = _reached(cut(arcs.select("net", "node", "reg", "v", "to").distinct()), src, max_rounds)
    weights = [f"w{i}" for i in range(metrics)]
    wide = arcs.groupBy("net", "node", "v").agg(*[F.max(F.when(F.col("metric") == i, F.col("w"))).alias(c) for i, c in enumerate(weights)])
    rows = reached.select("net", "blk", F.explode("nodes").alias("node")).join(wide.hint("merge"), ["net", "node"]).select("net", "blk", "node", "v", *weights)
    own = src.join(far, ["net", "blk"], "left_anti").select("net", "blk", "node", F.lit(None).cast(dict(src.dtypes)["node"]).alias("v"), *[F.lit(None).cast("double").alias(c) for c in weights])
    types = dict(src.dtypes)
    schema = f"net {types['net']}, metric int, lo {types['node']}, hi {types['node']}, f double"
    f = rows.unionByName(own).groupBy("net", "blk").applyInArrow(_shares_of(metrics), schema)
    return cut(f.groupBy("net", "metric", "lo", "hi").agg(F.sum("f").alias("f"))), far


def _far_shares(out_: DataFrame, back: DataFrame, src: DataFrame, metrics: Column, types: dict, max_rounds: int) -> DataFrame:
    """(net, metric, lo, hi, f) carried from blocks of sources that may reach anywhere: regions settle one by one, round by round."""
    schema = _STATE.format(net=types["net"], node=types["node"])
    spot = lambda hit, rest: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.when(i == F.col("slot"), F.lit(hit)).otherwise(F.lit(rest)))
    # every sweep begins with messages that nodes send to themselves
    start = cut(src.select("net", metrics, "blk", "reg", "node", F.lit(0.0).alias("w"), spot(0.0, float("inf")).alias("d"), spot(1.0, 0.0).alias("inc")))
    far = _until_still(out_, None, start, "distance", schema, max_rounds)
    blank = lambda df: df.withColumns({"acc": F.transform("d", lambda _: F.lit(0.0)), "inc": F.lit(None).cast("array<double>"), "live": F.lit(False)})
    paths = _until_still(out_, blank(far), start, "paths", schema, max_rounds)
    each = F.transform("acc", lambda c: F.when(c > 0, 1.0 / c).otherwise(F.lit(0.0)))
    home = paths.select(*_GROUP, "node", F.lit(0.0).alias("w"), "d", each.alias("inc"))
    dep = _until_still(back, blank(far), home, "back", schema, max_rounds)
    near = paths.select(*_KEY, F.col("d").alias("du"), F.col("acc").alias("cu"))
    to = dep.select("net", "metric", "blk", F.col("node").alias("v"), F.col("d").alias("dt"), F.col("acc").alias("xt"))
    on = out_.join(near, ["net", "metric", "node"]).join(to, ["net", "metric", "blk", "v"])
    carried = F.aggregate(F.arrays_zip("du", "cu", "dt", "xt"), F.lit(0.0), lambda a, z: a + F.when(
        (z["du"] + F.col("w") == z["dt"]) & (z["dt"] < float("inf")), z["cu"] * z["xt"]).otherwise(F.lit(0.0)))
    return cut(on.groupBy("net", "metric", F.least("node", "v").alias("lo"), F.greatest("node", "v").alias("hi")).agg(F.sum(carried).alias("f")))


def betweenness(edges: DataFrame, nodes: DataFrame, weights: list[str], k: int | None = None, max_rounds: int = 100_000,
                seed: int = 0) -> DataFrame:
    """Shortest-path share of every street by each of ``weights`` (metric: its place in the list), both directions summed and normalised by n(n-1).

    Exact, from every node, unless ``k`` asks for that many sources a network; ``exact`` tells which.

    First it is found which nodes each block of NEAR_SOURCES neighbouring sources reaches.  Where these and their arcs are
    of bounded number, they come to one task, which returns sums by arc alone.  The other blocks are taken in turns, as many as
    FAR_ROWS allow: a row holds the values of a node for
    a block of neighbouring sources that reach it; nodes out of reach have no row.  Three sweeps follow each other:
    distances fall to their least; numbers of shortest paths go out along the arcs that attain them, and each node passes on
    what it has just received; and (1 + dependency) / paths comes back the same way.  A street carries the
    product of its near end's paths and its far end's sum.  Neighbouring nodes form regions of bounded size: in a
    round a region settles within, and only what changed at its border is sent on, so the rounds are as many as
    regions lie along a path, not as many as its streets.  Weights must be above
    zero; arcs of weight null or not above zero are left out.
    """
    ends = nodes.select("net", "node").distinct()
    # neighbours share a region, neighbouring sources a block: numbered in the order of the node ids
    seat = cut(ordered_index(ends, ["net"], "node", "_i").select("net", "node", F.floor(F.col("_i") / REGION).alias("reg")))
    of = lambda i, c: edges.where(F.col("src") != F.col("dst")).where(F.col(c) > 0).groupBy("net", "src", "dst").agg(
        F.min(F.col(c).cast("double")).alias("w")).select("net", F.lit(i).alias("metric"), F.col("src").alias("node"), F.col("dst").alias("v"), "w")
    arcs = reduce(lambda a, b: a.unionByName(b), [of(i, c) for i, c in enumerate(weights)])
    out_ = cut(arcs.join(seat, ["net", "node"]).join(seat.select("net", F.col("node").alias("v"), F.col("reg").alias("to")), ["net", "v"]))
    back = out_.select("net", "metric", F.col("v").alias("node"), F.col("to").alias("reg"), F.col("node").alias("v"), F.col("reg").alias("to"), "w")
    metrics = F.explode(F.array(*[F.lit(i) for i in range(len(weights))])).alias("metric")
    pivots = cut(pick_pivots(nodes, k, seed=seed))
    src = cut(ordered_index(pivots, ["net"], "node", "_i").join(seat, ["net", "node"]).select("net", "node", "reg", "_i"))
    at = lambda many: F.floor(F.col("_i") / many).alias("blk")
    tot, far = _near_shares(out_, src.select("net", "node", "reg", at(NEAR_SOURCES)), len(weights), max_rounds)
    if not far.isEmpty():
        rest = src.withColumn("_b", at(NEAR_SOURCES)).join(far.withColumnRenamed("blk", "_b"), ["net", "_b"], "left_semi")
        rest = cut(rest.select("net", "node", "reg", at(BLOCK), (F.col("_i") % BLOCK).cast("int").alias("slot")))
        many = rest.select("net", "blk").distinct().join(seat.groupBy("net").agg(F.count("*").alias("_n")), "net").agg(F.sum("_n")).first()[0] * len(weights)
        turns = math.ceil(many / FAR_ROWS)
        for q in range(turns):
            now = rest.where(F.pmod(F.xxhash64("net", "blk"), F.lit(turns)) == q)
            if not now.isEmpty():
                tot = tot.unionByName(_far_shares(out_, back, now, metrics, dict(nodes.dtypes), max_rounds))
            let_go(edges.sparkSession)
        tot = tot.groupBy("net", "metric", "lo", "hi").agg(F.sum("f").alias("f"))
    size = nodes.groupBy("net").agg(F.count("*").cast("double").alias("n"))
    scale = pivots.groupBy("net").agg(F.max("scale").alias("scale"), (F.max("scale") == 1.0).alias("exact"))
    und = shortest_undirected(edges, ["net"]).select("net", "lo", "hi", metrics)
    share = F.col("f") * F.col("scale") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return cut(und.join(tot, ["net", "metric", "lo", "hi"], "left").join(scale, "net", "left").join(size, "net", "left")
               .select("net", "metric", "lo", "hi", F.coalesce(share, F.lit(0.0)).alias("betweenness"), "exact"))


def edge_betweenness(edges: DataFrame, nodes: DataFrame, weight: str = "travel_time", k: int | None = None,
                     max_rounds: int = 100_000, seed: int = 0) -> DataFrame:
    """``betweenness`` by one weight: (net, lo, hi, betweenness, exact)."""
    return betweenness(edges, nodes, [weight], k, max_rounds, seed).drop("metric")
