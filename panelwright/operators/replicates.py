"""Newton steps of many weighted replicates at once: one vector of weights a row, dense sums by group and replicate.

Rows of one group and one unit come packed as one piece, with that unit's weights in all replicates; where
replicates differ by their outcomes, a piece has the outcomes' sums in their place, which no slope changes.  A round takes
rows x replicates as matrices, batch by batch, into sums of each piece and group (one block of replicates x moments); from a
whole group's block the group effects drop out in closed form, and scores and Hessians are
added up by model.  Groups lie whole in one partition; only of groups so large that they are
dealt out do blocks move.  The driver gets one row a model and holds the slopes: models x replicates x slopes, of a checked size.
Replicates that have settled leave the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ppml import ETA_CAP, RIDGE, SCORE_FLOOR, TOL
from panelwright.session import cut

MOST_BYTES = 256 << 20          # of slopes that every task is sent
BLOCK_VALUES = 4 << 20          # of one rows x replicates matrix
SALT_ROWS = 50_000              # rows of a group in one task


def _lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _dense(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def with_weights(d: DataFrame, draws: DataFrame, keys: list[str], unit: str, reps: int) -> DataFrame:
    """Design rows with ``m``, the number of times each replicate drew the row's unit; rows of units never drawn go."""
    types = {f.name: f.dataType.simpleString() for f in draws.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "unit"]) + ", m array<smallint>"

    def dense(batches):
        for b in batches:
            out = np.zeros((b.num_rows, reps), np.int16)
            lists = b.column("draws")
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            out[row, flat.field("rep").to_numpy()] = flat.field("m").to_numpy().astype(np.int16)
            m = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * reps), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in (*keys, "unit")] + [m], names=[*keys, "unit", "m"])
    wide = draws.select(*keys, "unit", "m") if "m" in draws.columns else draws.select(*keys, "unit", "draws").mapInArrow(dense, schema)
    return d.join(wide.withColumnRenamed("unit", unit), [*keys, unit])


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


class _Moments:
    """Sums of one block of rows of one model: (groups, moments, active replicates)."""

    def __init__(self, p: int):
        self.p, self.tri = p, [(j, k) for j in range(p) for k in range(j + 1)]
        self.n = 2 + 2 * p + len(self.tri)

    def of(self, x: np.ndarray, off: np.ndarray, sizes: np.ndarray, y: np.ndarray, m, slopes: np.ndarray) -> np.ndarray:
        """Sums of pieces, of which ``sizes`` tells the rows.

        ``x`` rows x p, ``y`` outcomes' sums and those with each of x, pieces x (1 + p) x active or 1, ``m`` weights
        pieces x active (or None), ``slopes`` active x p.
        """
        if m is not None and (slopes == slopes[0]).all():
            slopes = slopes[:1]                             # the first step, from the base fit
        e = x @ slopes.T
        e += off[:, None]
        np.exp(np.clip(e, -ETA_CAP, ETA_CAP, out=e), out=e)
        by = np.concatenate([np.ones((len(x), 1)), x, *[x[:, [j]] * x[:, [k]] for j, k in self.tri]], axis=1)
        sums, first = np.empty((len(sizes), by.shape[1], e.shape[1])), np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            these = np.flatnonzero(sizes == n)
            rows = first[these][:, None] + np.arange(n)
            sums[these] = np.matmul(by[rows].transpose(0, 2, 1), e[rows])
        if m is not None:
            sums, y = sums * m[:, None, :], y * m[:, None, :]
        return np.concatenate([y[:, :1], sums[:, :1], y[:, 1:], sums[:, 1:]], axis=1)

    def steps(self, g: np.ndarray) -> np.ndarray:
        """From whole groups' sums to (scores, Hessian triangle, events) x replicates, added up over the groups."""
        sy, se = g[:, 0], g[:, 1]
        syx, sex, sxx = g[:, 2: 2 + self.p], g[:, 2 + self.p: 2 + 2 * self.p], g[:, 2 + 2 * self.p:]
        live = se > 0
        safe = np.where(live, se, 1.0)
        ratio = np.where(live, sy / safe, 0.0)
        score = [(syx[:, j] - ratio * sex[:, j]).sum(0) for j in range(self.p)]
        hess = [(ratio * (sxx[:, q] - sex[:, j] * sex[:, k] / safe)).sum(0) for q, (j, k) in enumerate(self.tri)]
        return np.stack([*score, *hess, sy.sum(0)])


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """(model key, rows of that model) in the order they come."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = _runs(cols)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            yield tuple(c[s] for c in cols), b.slice(s, e - s)


def _packed(d: DataFrame, keys: list[str], xs: list[str], unit: str) -> DataFrame:
    """(keys, grp, unit, y, off, x, _s, whole): a group's rows of one unit as one row of arrays, of a dealt group in parts."""
    row = F.struct("y", "off", F.array(*xs).alias("x"))
    got = d.groupBy(*keys, "grp", unit, "_s", "whole").agg(F.collect_list(row).alias("_r"))
    return got.select(*keys, "grp", unit, "_s", "whole", F.col("_r.y").alias("y"), F.col("_r.off").alias("off"), F.flatten("_r.x").alias("x"))


def _outcomes_summed(d: DataFrame, keys: list[str], kinds: str, outcomes: dict, p: int) -> DataFrame:
    """(keys, model_id, grp, whole, x, off, y): pieces with sums of each replicate's outcomes, alone and with each of x, drawn here and not kept."""
    names, draw = outcomes["names"], outcomes["draw"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                starts = _runs([part.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "grp")])
                x, off, n = _dense(part.column("x")), part.column("off").to_numpy(), len(starts)
                ends = np.append(starts, part.num_rows)
                lists = lambda v, width: pa.ListArray.from_arrays(pa.array((ends * width).astype(np.int32)), pa.array(np.ascontiguousarray(v).ravel()))
                head = part.take(pa.array(starts))
                for name, ys in zip(names, draw(part.column(outcomes["from"]))):
                    ys = ys.astype(np.float64)
                    y = np.stack([np.add.reduceat(ys if j < 0 else ys * x[:, [j]], starts, axis=0) for j in range(-1, p)], axis=1)
                    yield pa.RecordBatch.from_arrays([head.column(k) for k in keys] + [pa.array([name] * n), head.column("grp"), head.column("whole"), lists(x, p), lists(off, 1), _lists(y.reshape(n, -1))],
                                                     names=[*keys, "model_id", "grp", "whole", "x", "off", "y"])
    return d.mapInArrow(run, f"{kinds}model_id string, grp string, whole boolean, x array<double>, off array<double>, y array<double>")


def replicate_slopes(d: DataFrame, keys: list[str], reps: int, start: dict, max_iter: int = 60, draws: DataFrame | None = None, unit: str = "_unit",
                     outcomes: dict | None = None) -> DataFrame | None:
    """(keys, rep, b, iters, converged) for design rows with weights ``m``, or with a ``unit`` whose weights are in ``draws``.

    ``start``: slopes by model key (else zero).  ``outcomes``: rows without a model and weights; ``draw`` makes of the column
    ``from`` rows x replicates for each of ``names``, the models (the last of ``keys``).

    Returns None where the slopes of all models would be more than MOST_BYTES.
    """
    spark = d.sparkSession
    xs = sorted((c for c in d.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    p = len(xs)
    types = dict(d.dtypes) | {"model_id": "string"}
    at = keys[:-1] if outcomes else keys
    many = len(outcomes["names"]) if outcomes else 1
    models = [tuple(r) for r in d.select(*at).distinct().limit(MOST_BYTES // (8 * reps * p) + 1).collect()] if at else [()]
    if len(models) * many * reps * p * 8 > MOST_BYTES:
        return None
    if outcomes:
        models = [(*m, o) for m in models for o in outcomes["names"]]
    hot = d.groupBy(*at, "grp").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_n")).where("_n > 1")
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_n")), F.lit(0)).cast("int")
    split = hot.limit(10_001).count()
    rows = d.join(F.broadcast(hot) if split <= 10_000 else hot, [*at, "grp"], "left").withColumn("_s", salt).withColumn("whole", F.col("_n").isNull())
    if outcomes:
        rows = rows.select(*at, "grp", "off", F.array(*xs).alias("x"), outcomes["from"], "_s", "whole")
    elif draws is not None:
        keep = [k for k in draws.columns if k in keys]
        rows = with_weights(_packed(rows, keys, xs, unit), draws, keep, unit, reps)
    else:
        rows = rows.select(*keys, "grp", F.array("y").alias("y"), F.array("off").alias("off"), F.array(*xs).alias("x"), "m", "_s", "whole")
    rows = rows.repartition(*at, "grp", "_s").sortWithinPartitions(*at, "grp")
    if outcomes:
        rows = _outcomes_summed(rows, at, "".join(f"`{k}` {types[k]}, " for k in at), outcomes, p)
        rows = rows.sortWithinPartitions(*keys, "grp")
    rows = cut(rows)
    mom = _Moments(p)
    ks = ", ".join(f"`{k}` {types[k]}" for k in keys)
    sent = ks + ", grp string, whole boolean, g array<double>"
    slopes = {m: np.tile(np.asarray(start.get(m, np.zeros(p)), float)[:p], (reps, 1)) for m in models}
    active = {m: np.arange(reps) for m in models}
    done: list = []

    def totals(total):
        for key, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]) for k in key] + [pa.array([None], pa.string()), pa.array([True]), _lists(s.reshape(1, -1))],
                                             names=[*keys, "grp", "whole", "g"])

    def sums(shared):
        """Steps of each model from the groups that lie here whole, and sums of each group that is dealt out."""
        def run(batches):
            total, open_ = {}, None

            def add(key, g):
                s = mom.steps(g)
                total[key] = total[key] + s if key in total else s
            for key, b in _blocks(batches, keys):
                state = shared.value.get(key)
                if state is None:
                    continue
                at, slope = state
                sizes = b.column("off").value_lengths().to_numpy()
                cost = np.cumsum(sizes + mom.n) * len(at)
                lo = 0
                while lo < b.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + BLOCK_VALUES, side="right")))
                    part, size = b.slice(lo, hi - lo), sizes[lo:hi]
                    lo = hi
                    grp = part.column("grp").to_numpy(zero_copy_only=False)
                    starts = _runs([grp])
                    x, off = part.column("x").flatten().to_numpy().reshape(-1, p), part.column("off").flatten().to_numpy()
                    if outcomes:
                        m, y = None, _dense(part.column("y")).reshape(len(part), 1 + p, -1)[:, :, at]
                    else:
                        m, one = _dense(part.column("m"))[:, at].astype(np.float64), part.column("y").flatten().to_numpy()
                        y = np.add.reduceat(np.column_stack([one, one[:, None] * x]), np.cumsum(size) - size, axis=0)[:, :, None]
                    g = np.add.reduceat(mom.of(x, off, size, y, m, slope), starts, axis=0)
                    whole = part.column("whole").to_numpy(zero_copy_only=False)[starts]
                    dealt, here = np.flatnonzero(~whole), np.flatnonzero(whole)
                    if len(dealt):
                        n = len(dealt)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * n, part.schema.field(c).type) for k, c in zip(key, keys)] + [
                            part.column("grp").take(pa.array(starts[dealt])), pa.array(np.zeros(n, bool)), _lists(g[dealt].reshape(n, -1))],
                            names=[*keys, "grp", "whole", "g"])
                    if len(here):
                        # a group may go on over several batches: the last one stays open
                        if open_ is not None and open_[:2] == (key, grp[starts[here[0]]]):
                            g[here[0]] += open_[2]
                        elif open_ is not None:
                            add(open_[0], open_[2][None])
                        if len(here) > 1:
                            add(key, g[here[:-1]])
                        open_ = key, grp[starts[here[-1]]], g[here[-1]].copy()
            if open_ is not None:
                add(open_[0], open_[2][None])
            yield from totals(total)
        return run

    def by_group(batches):
        """Blocks come ordered by group: adds those of a group that was dealt out up, then all of a model."""
        total, open_ = {}, None

        def add(key, s):
            total[key] = total[key] + s if key in total else s
        for key, b in _blocks(batches, keys):
            whole = b.column("whole")
            ready = b.filter(whole)
            if ready.num_rows:
                add(key, _dense(ready.column("g")).sum(0).reshape(p + len(mom.tri) + 1, -1))
            b = b.filter(pa.array(~whole.to_numpy(zero_copy_only=False)))
            if not b.num_rows:
                continue
            grp = b.column("grp").to_numpy(zero_copy_only=False)
            g = _dense(b.column("g"))
            g = g.reshape(len(g), mom.n, -1)
            starts = _runs([grp])
            sums_ = np.add.reduceat(g, starts, axis=0)
            for q, s in enumerate(starts.tolist()):
                if open_ is not None and open_[:2] == (key, grp[s]):
                    open_ = key, grp[s], open_[2] + sums_[q]
                else:
                    if open_ is not None:
                        add(open_[0], mom.steps(open_[2][None]))
                    open_ = key, grp[s], sums_[q]
        if open_ is not None:
            add(open_[0], mom.steps(open_[2][None]))
        yield from totals(total)

    def by_model(batches):
        total: dict = {}
        for key, b in _blocks(batches, keys):
            s = _dense(b.column("g")).sum(0)
            total[key] = total[key] + s if key in total else s
        yield from totals(total)

    for it in range(1, max_iter + 1):
        live = {m: (active[m], slopes[m][active[m]]) for m in models if len(active[m])}
        if not live:
            break
        shared = spark.sparkContext.broadcast(live)
        told = rows.mapInArrow(sums(shared), sent)
        if split:
            told = told.repartition(*keys, "grp").sortWithinPartitions(*keys, "grp").mapInArrow(by_group, sent)
        # one row a model comes to the driver
        told = told.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(by_model, sent).toArrow()
        added = {tuple(told[k][i].as_py() for k in keys): told["g"][i].values.to_numpy() for i in range(told.num_rows)}
        for m, (at, _) in live.items():
            s = added.get(m, np.zeros((p + len(mom.tri) + 1) * len(at))).reshape(-1, len(at))
            h = np.zeros((len(at), p, p))
            for q, (j, k) in enumerate(mom.tri):
                h[:, j, k] = h[:, k, j] = s[p + q]
            step = np.full((len(at), p), np.nan)
            ok = np.isfinite(h).all((1, 2))
            step[ok] = np.linalg.solve(h[ok] + RIDGE * np.eye(p), s[:p].T[ok][:, :, None])[:, :, 0]
            flat = np.abs(s[:p]).max(0) <= SCORE_FLOOR * np.maximum(s[-1], 1.0)
            slopes[m][at] += step
            size = np.where(flat, 0.0, np.abs(step).max(1))
            over = (size < TOL) | np.isnan(size)
            done += [(*m, int(r), slopes[m][r].tolist(), it, bool(z < TOL)) for r, z in zip(at[over], size[over])]
            active[m] = at[~over]
    done += [(*m, int(r), slopes[m][r].tolist(), max_iter, False) for m in models for r in active[m]]
    return spark.createDataFrame(done, ks + ", rep int, b array<double>, iters int, converged boolean")
