"""Bootstrap by weights and label noise, deterministic by hash.

A cluster drawn m times and relabelled is m identical copies with their own
effect, which is the cluster weighted by m.  So a replicate is a weight
column, never copied rows, and all replicates of all models are fitted in one
batched job.  Randomness is ``xxhash64(seed, rep, key)``: it does not depend on
the plan or the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ppml import Spec, build_design, centre_within, coef_row, newton_slopes, ppml_fe
from panelwright.operators.ranks import dense_index, with_group
from panelwright.operators.replicates import replicate_slopes
from panelwright.session import cut


UNITS_AT_ONCE = 1024            # units whose draws are counted together
SLOTS_AT_ONCE = 1 << 20         # draws of one replicate that are made together
PRIMES = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hash_longs(v: np.ndarray, seed: int) -> np.ndarray:
    """What ``xxhash64`` gives for each long ``v`` after columns that hash to ``seed``."""
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    p1, p2, p3, p4, p5 = PRIMES
    h = np.uint64((seed + int(p5) + 8) % (1 << 64)) ^ (turn(v.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def multiplicities(units: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """Draw G of each key's G units with replacement, ``reps`` times: (keys, unit, m), m the number of times in each replicate.

    ``units`` has one row per (keys, unit).  Slot j of replicate r picks index
    hash(seed, r, key, j) mod G.  A task draws SLOTS_AT_ONCE slots of one key and replicate at most and sends
    what it picked as lists for UNITS_AT_ONCE units each, so neither a draw is a row nor a key sampled in one task.  Units never drawn have no row.
    """
    idx = cut(dense_index(units, keys, F.xxhash64(F.lit(seed), *[F.col(c) for c in keys], F.col("unit")), "j").select(
        *keys, "unit", F.col("j").cast("bigint").alias("j"), F.floor(F.col("j") / UNITS_AT_ONCE).cast("bigint").alias("_jb")))
    size = idx.groupBy(*keys).agg(F.count("*").alias("_g"))
    size = size.where("_g > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1, F.lit(SLOTS_AT_ONCE).cast("bigint"))))
    size = size.repartition(*keys, "rep", "_lo").withColumn("_h", F.xxhash64(F.lit(seed), "rep", *[F.col(c) for c in keys]))
    types = dict(units.dtypes)
    ks = "".join(f"`{k}` {types[k]}, " for k in keys)

    def pick(batches):
        for b in batches:
            for i in range(b.num_rows):
                g, lo, h = (b.column(c)[i].as_py() for c in ("_g", "_lo", "_h"))
                at = np.sort(_hash_longs(np.arange(lo, min(lo + SLOTS_AT_ONCE, g)), h) % g)
                blk = at // UNITS_AT_ONCE
                first = np.flatnonzero(np.append(True, blk[1:] != blk[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at % UNITS_AT_ONCE).astype(np.int16)))
                n = len(first)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(b.column(k)[i], n) for k in keys], pa.array(blk[first]), pa.repeat(b.column("rep")[i], n), lists], names=[*keys, "_jb", "rep", "at"])

    def count(key, own: pa.Table, picked: pa.Table) -> pa.Table:
        lists = picked.column("at").combine_chunks()
        rep = np.repeat(picked.column("rep").to_numpy(), lists.value_lengths().to_numpy())
        m = np.bincount(lists.flatten().to_numpy().astype(np.int64) * reps + rep, minlength=UNITS_AT_ONCE * reps).reshape(-1, reps)
        m = m[own.column("j").to_numpy() % UNITS_AT_ONCE].astype(np.int16)
        some = np.flatnonzero(m.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * reps), pa.array(m[some].ravel()))
        return pa.Table.from_arrays([*[own.column(k).take(pa.array(some)) for k in (*keys, "unit")], lists], names=[*keys, "unit", "m"])
    picked = size.mapInArrow(pick, f"{ks}_jb bigint, rep int, at array<smallint>")
    return idx.groupBy(*keys, "_jb").cogroup(picked.groupBy(*keys, "_jb")).applyInArrow(count, f"{ks}unit {types['unit']}, m array<smallint>")


def as_draws(m: DataFrame) -> DataFrame:
    """``multiplicities`` with (rep, m) of the replicates that drew the unit, as ``draws``."""
    each = F.transform("m", lambda v, i: F.struct(i.alias("rep"), v.cast("double").alias("m")))
    return m.withColumn("draws", F.filter(each, lambda z: z["m"] > 0)).drop("m")


def draw_multiplicity(units: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """``multiplicities`` as (keys, unit, [(rep, m)])."""
    return as_draws(multiplicities(units, keys, reps, seed))


def weighted_replicates(d: DataFrame, draws: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Design rows with one copy per replicate that drew their unit, weighted by the draws."""
    j = d.join(draws.withColumnRenamed("unit", unit), [*keys, unit])
    cols = [c for c in d.columns if c != "w"]
    return j.select(*cols, F.explode("draws").alias("_r")).select(
        *cols, F.col("_r.rep").alias("rep"), F.col("_r.m").alias("w"))


def bootstrap_slopes(df: DataFrame, specs: list[Spec], keys: list[str], unit: Column, reps: int, seed: int,
                     group: str = "GEOID", max_iter: int = 60, start: DataFrame | None = None) -> DataFrame:
    """First slope of every (key, spec, replicate) that converged: the refits behind each interval.

    Replicates go as weight vectors (``replicates``) and begin at the slopes of ``start``, the
    base fit; only where the slopes of all models are too many to send around, rows are copied by replicate.
    """
    km = [*keys, "model_id"]
    d = build_design(df.withColumn("_unit", unit.cast("string")), specs, keys, group, carry=["_unit"])
    d = centre_within(d, km).persist()
    try:
        units = df.select(*keys, unit.cast("string").alias("unit")).distinct()
        draws = multiplicities(units, keys, reps, seed).persist()
        at = {} if start is None else {tuple(r[k] for k in km): r["b"] for r in start.select(*km, "b").limit(100_000).collect()}
        fit = replicate_slopes(d, km, reps, at, max_iter, draws=draws, unit="_unit")
        if fit is None:
            fit = newton_slopes(weighted_replicates(d, as_draws(draws), keys, "_unit").drop("_unit"), [*km, "rep"], max_iter)
        out = cut(fit.where("converged").select(*km, "rep", F.get("b", F.lit(0)).alias("beta")))
        draws.unpersist()
        return out
    finally:
        d.unpersist()


def _interval(g: list[str], d: DataFrame, col: str, names: tuple[str, str]) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates (a bounded number of values per model)."""
    return d.groupBy(*g).agg(F.percentile(col, [0.025, 0.975]).alias("_q"), F.count("*").alias("n_boot_ok"),
                             F.stddev_samp(col).alias("se_boot")).select(
        *g, "n_boot_ok", "se_boot", F.col("_q")[0].alias(names[0]), F.col("_q")[1].alias(names[1]))


def cluster_bootstrap_diff(df: DataFrame, a: Spec, b: Spec, keys: list[str], reps: int = 600, seed: int = 17,
                           group: str = "GEOID", cap: float = 5.0) -> DataFrame:
    """Difference of two outcomes' coefficients with both refitted inside every cluster draw."""
    first = ppml_fe(df, [a, b], keys, group)
    base = coef_row(first).groupBy(*keys).agg(
        *[F.max(F.when(F.col("model_id") == s.model_id, F.col(c))).alias(f"{c}_{n}")
          for s, n in ((a, "a"), (b, "b")) for c in ("beta", "pct")])
    s = bootstrap_slopes(df, [a, b], keys, F.col(group), reps, seed, group, start=first)
    pick = lambda m: F.max(F.when(F.col("model_id") == m, F.col("beta")))
    w = s.groupBy(*keys, "rep").agg(pick(a.model_id).alias("ba"), pick(b.model_id).alias("bb"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < cap)
    w = w.where(good("ba") & good("bb")).withColumn("diff", F.col("ba") - F.col("bb"))
    ci = _interval(keys, w, "diff", ("diff_lo", "diff_hi"))
    out = base.join(ci, keys, "left") if keys else base.join(F.broadcast(ci))
    enough = F.col("n_boot_ok") > 50
    lo, hi = F.when(enough, F.col("diff_lo")), F.when(enough, F.col("diff_hi"))
    return out.withColumns({
        "diff_beta": F.col("beta_a") - F.col("beta_b"), "diff_pct_pts": F.col("pct_a") - F.col("pct_b"),
        "diff_lo": lo, "diff_hi": hi, "contains_zero": (lo <= 0) & (hi >= 0)}).drop("se_boot")


def tile_of(x: Column, y: Column, tile_m: float = 1000.0) -> Column:
    """Floor tile number, as one string key."""
    return F.concat_ws("_", F.floor(x / tile_m).cast("string"), F.floor(y / tile_m).cast("string"))


def spatial_block_bootstrap(df: DataFrame, spec: Spec, keys: list[str], reps: int = 400, seed: int = 11,
                            tile_m: float = 1000.0, group: str = "GEOID", cap: float = 2.0) -> DataFrame:
    """Resample square tiles.  A copy of a tile keeps its own effects, so the effect key is
    (group, tile) with the tile's draw count as weight; thin pieces (<3 rows) drop out."""
    first = ppml_fe(df, [spec], keys, group)
    base = coef_row(first).select(*keys, "beta", "se", "pct", "lo", "hi")
    d = df.withColumn("_tile", tile_of(F.col("x"), F.col("y"), tile_m))
    tiles = d.groupBy(*keys).agg(F.countDistinct("_tile").alias("n_tiles"))
    d = d.withColumn("_fe", F.concat_ws("|", F.col(group).cast("string"), "_tile"))
    thin = with_group(d, [*keys, "_fe"], _sz=F.count("*"))
    # every tile is a unit to draw, also one whose pieces are all thin: its rows carry no weight
    d = thin.withColumn("_in", F.col("_sz") >= 3)
    one = Spec(spec.model_id, spec.y, spec.x, spec.offset, where=F.col("_in"))
    s = bootstrap_slopes(d, [one], keys, F.col("_tile"), reps, seed, "_fe", start=first)
    ok = s.where(F.col("beta").isNotNull() & ~F.isnan("beta") & (F.abs("beta") < cap))
    ci = _interval(keys, ok, "beta", ("_lo", "_hi"))
    return (base.join(tiles, keys).join(ci, keys, "left")
                .withColumns({"lo_spatial_block": 100 * (F.exp("_lo") - 1), "hi_spatial_block": 100 * (F.exp("_hi") - 1),
                              "se_ratio": F.col("se_boot") / F.col("se")})
                .withColumnRenamed("se_boot", "se_spatial_block").withColumnRenamed("n_boot_ok", "draws_ok").drop("_lo", "_hi"))


def multi_spec_bootstrap(df: DataFrame, specs: list[Spec], keys: list[str], reps: int = 300, seed: int = 11,
                         group: str = "GEOID") -> DataFrame:
    """Several specs refitted on the same draws; intervals of each and of its gap to the first."""
    s = bootstrap_slopes(df, specs, keys, F.col(group), reps, seed, group, start=ppml_fe(df, specs, keys, group))
    s = s.where(~F.isnan("beta"))
    first = s.where(F.col("model_id") == specs[0].model_id).select(*keys, "rep", F.col("beta").alias("b0"))
    w = s.join(first, [*keys, "rep"]).withColumn("gap", F.col("beta") - F.col("b0"))
    k = [*keys, "model_id"]
    return _interval(k, w, "beta", ("lo", "hi")).join(
        _interval(k, w, "gap", ("gap_lo", "gap_hi")).drop("n_boot_ok", "se_boot"), k)


TRIALS = 512                    # of one binomial draw; more are drawn in parts, whose sum has the same law
GOLD, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _uniform(base: np.ndarray, *steps) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys and counters, mixed one after the other."""
    h = base.astype(np.uint64)
    for s in steps:
        h = h + (np.asarray(s).astype(np.uint64) + np.uint64(1)) * GOLD
        h = (h ^ (h >> np.uint64(30))) * MIX_A
        h = (h ^ (h >> np.uint64(27))) * MIX_B
        h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def binomial_quantile(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Least k with P(X <= k) >= u for X binomial (n up to TRIALS, p), by adding up probabilities from 0.

    Where p is above one half the failures are drawn, so the first probability never underflows.
    """
    n, p, u = np.broadcast_arrays(n.astype(np.int64), np.clip(p, 0.0, 1.0), u)
    turn = p > 0.5
    q = np.where(turn, 1 - p, p)
    odds = q / (1 - q)
    term = np.power(1 - q, n)
    total, k = term.copy(), np.zeros(n.shape, np.int64)
    open_ = (total < u) & (k < n)
    while open_.any():
        at = np.nonzero(open_)
        k[at] += 1
        term[at] *= (n[at] - k[at] + 1) / k[at] * odds[at]
        total[at] += term[at]
        open_[at] = (total[at] < u[at]) & (k[at] < n[at])
    return np.where(turn, n - k, k)


def _binomial(n: np.ndarray, p: float, key: np.ndarray, reps: np.ndarray, cls: int) -> np.ndarray:
    """Draws (rows x replicates) from Bin(n, p); n is rows x replicates."""
    out, left, part = np.zeros(n.shape, np.int64), n.copy(), 0
    while left.any():
        now = np.minimum(left, TRIALS)
        some = np.nonzero(now)
        u = _uniform(key[some[0]], reps[some[1]], np.full(len(some[0]), cls), np.full(len(some[0]), part))
        out[some] += binomial_quantile(now[some], np.full(len(some[0]), p), u)
        left, part = left - now, part + 1
    return out


def _shares(confusion: DataFrame) -> dict:
    return {r.pred: [(t, p) for t, p in r.row] for r in confusion.where("p > 0").groupBy("pred").agg(
        F.array_sort(F.collect_list(F.struct("truth", "p"))).alias("row")).collect()}            # a taxonomy squared


def _splits(pred: np.ndarray, n: np.ndarray, base: np.ndarray, shares: dict, every: np.ndarray):
    """(rows, true class, their counts of it in every replicate) for counts ``n`` of predicted classes."""
    for c in sorted(set(pred)):
        rows = np.flatnonzero(pred == c)
        left, rest = np.repeat(n[rows][:, None], len(every), axis=1), 1.0
        row = shares.get(c) or [(c, 1.0)]
        whole = sum(p for _, p in row)
        for q, (truth, p) in enumerate(row):
            last = q == len(row) - 1
            got = left if last else _binomial(left, min(p / whole / rest, 1.0), base[rows], every, q)
            left, rest = left - got, max(rest - p / whole, 1e-300)
            yield rows, truth, got


def relabelled(counts: DataFrame, confusion: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """(keys, truth, ns): counts of true classes in every replicate as one array, given P(true | predicted).

    ``counts`` is (keys, pred, n).  The n incidents of a row are split over the true classes by
    binomial draws, each from what the classes before it have left, so neither an incident nor a replicate is ever a
    row.  Draws depend on (seed, keys, pred, replicate) alone; classes without a confusion row stay as they are.
    """
    shares = _shares(confusion)
    key = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], "pred").alias("_key")
    d = counts.where("n > 0").select(*keys, "pred", F.col("n").cast("bigint").alias("n"), key)
    types = dict(d.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", truth string, ns array<bigint>"

    def run(batches):
        every = np.arange(reps)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                pred = np.array(part.column("pred").to_pylist(), object)
                n, base = part.column("n").to_numpy(), part.column("_key").to_numpy().view(np.uint64)
                for rows, truth, got in _splits(pred, n, base, shares, every):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * reps), pa.array(got.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(rows)) for k in keys] + [pa.array([truth] * len(rows)), lists],
                                                     names=[*keys, "truth", "ns"])
    return d.mapInArrow(run, schema)


def relabel_draws(counts: DataFrame, confusion: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """``relabelled`` as rows (keys, rep, truth, n)."""
    d = relabelled(counts, confusion, keys, reps, seed).select(*keys, "truth", F.posexplode("ns").alias("rep", "n"))
    return d.where("n > 0").groupBy(*keys, "rep", "truth").agg(F.sum("n").alias("n"))


def _drawn(shares: dict, outcomes: dict[str, list[str]], reps: int):
    """From lists (pred, n, key) of each row to the rows x replicates of every outcome."""
    every = np.arange(reps)

    def draw(lists: pa.ListArray) -> list[np.ndarray]:
        sums = [np.zeros((len(lists), reps), np.int64) for _ in outcomes]
        flat = lists.flatten()
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        pred = np.array(flat.field("pred").to_pylist(), object)
        n, base = flat.field("n").to_numpy(), flat.field("key").to_numpy().view(np.uint64)
        for lo in range(0, len(of), 2000):
            now = slice(lo, lo + 2000)
            for rows, truth, got in _splits(pred[now], n[now], base[now], shares, every):
                for total, classes in zip(sums, outcomes.values()):
                    if truth in classes:
                        np.add.at(total, of[now][rows], got)
        return sums
    return draw


def expected_relabel(counts: DataFrame, confusion: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the draws: sum over predicted classes of n times P(true | predicted)."""
    j = counts.join(confusion.where("p > 0"), "pred")
    return j.groupBy(*keys, "truth").agg(F.sum(F.col("n") * F.col("p")).alias("n"))


def _with_outcomes(design: DataFrame, names: list[str], draw) -> DataFrame:
    """One row for each design row, outcome (``model_id``) and replicate (``rep``), with its ``y``."""
    d = design.drop("y")
    cols = [c for c in d.columns if c != "_counts"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                for name, ys in zip(names, draw(part.column("_counts"))):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1, dtype=np.int32) * ys.shape[1]), pa.array(ys.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in cols] + [pa.array([name] * len(ys)), lists], names=[*cols, "model_id", "ys"])
    types = dict(d.dtypes)
    wide = d.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", model_id string, ys array<bigint>")
    return wide.select(*cols, "model_id", F.posexplode("ys").alias("rep", "y")).withColumn("y", F.col("y").cast("double"))


def label_noise_draws(df: DataFrame, counts: DataFrame, confusion: DataFrame, property_classes: list[str], x: list[str],
                      keys: list[str], cell: str = "cell", reps: int = 200, seed: int = 20260804,
                      offset: str = "exposure", group: str = "GEOID", theft: list[str] = (), no_loot: str = "NO_LOOT") -> DataFrame:
    """Refit the total under every relabelling; label sd joins the sampling error.

    diff_sd_label is the spread of the theft coefficient minus that of incidents without loot (``theft`` lists the classes).
    """
    first = ppml_fe(df, [Spec("base", "n_total", x, offset)], keys, group)
    base = coef_row(first).select(*keys, "beta", "se", "pct")
    outcomes = {"total": list(property_classes)} | ({"theft": list(theft), "noloot": [no_loot]} if theft else {})
    at, km = [*keys, cell], [*keys, "model_id"]
    # a cell's counts ride along as they are: draws are made where a group's rows meet, and only their sums by group are kept
    key = F.xxhash64(F.lit(seed), *[F.col(k) for k in at], "pred").alias("key")
    own = counts.where("n > 0").groupBy(*at).agg(F.collect_list(F.struct("pred", F.col("n").cast("bigint").alias("n"), key)).alias("_counts"))
    design = build_design(df.join(own, at, "left").withColumn("_one", F.lit(1.0)), [Spec("all", "_one", x, offset)], keys, group, carry=["_counts"])
    design = centre_within(design, km).drop("model_id").persist()
    draw = _drawn(_shares(confusion), outcomes, reps)
    try:
        start = {(*[r[k] for k in keys], o): r["b"] for r in first.select(*keys, "b").limit(100_000).collect() for o in outcomes}
        fit = replicate_slopes(design, km, reps, start, outcomes={"names": list(outcomes), "from": "_counts", "draw": draw})
        if fit is None:
            fit = newton_slopes(_with_outcomes(design, list(outcomes), draw), [*km, "rep"], 60)
        fit = cut(fit.where("converged").select(*km, "rep", F.get("b", F.lit(0)).alias("b")))
    finally:
        design.unpersist()
    of = lambda o: F.max(F.when(F.col("model_id") == o, F.col("b")))
    wide = fit.groupBy(*keys, "rep").agg(of("total").alias("t"), (of("theft") - of("noloot") if theft else F.lit(None).cast("double")).alias("diff"))
    sd = wide.groupBy(*keys).agg(F.count("t").alias("draws"), F.stddev_samp("t").alias("se_label"),
                                 F.when(F.count("diff") > 2, F.stddev_samp("diff")).alias("diff_sd_label"))
    out = base.join(sd, keys) if keys else base.join(F.broadcast(sd))
    total = F.sqrt(F.col("se") * F.col("se") + F.col("se_label") * F.col("se_label"))
    return out.withColumns({
        "se_total": total, "pct_lo_total": 100 * (F.exp(F.col("beta") - 1.96 * total) - 1),
        "pct_hi_total": 100 * (F.exp(F.col("beta") + 1.96 * total) - 1),
        "label_share_of_var": F.col("se_label") * F.col("se_label") / (total * total)})


def iid_bootstrap_wls(df: DataFrame, keys: list[str], x: str, y: str, w: Column, reps: int = 4000, seed: int = 7) -> DataFrame:
    """Resample rows, refit the weighted line by its closed form, and report percentile bounds.

    Each row is a unit of its own: equal rows are told apart by a number among them, dealt
    in two steps so that no array is longer than about the root of their count.
    """
    d = df.withColumn("_w", w).withColumn("_same", F.xxhash64(*[F.col(c) for c in df.columns]))
    n = d.groupBy(*keys, "_same").agg(F.first(x).alias("x"), F.first(y).alias("y"), F.first("_w").alias("_w"), F.count("*").alias("_n"))
    step = F.ceil(F.sqrt("_n")).cast("bigint")
    n = n.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, step)))
    n = n.withColumn("_b", F.explode(F.sequence("_a", F.least(F.col("_a") + step, F.col("_n")) - 1)))
    dup = n.withColumn("unit", F.concat_ws("-", "_same", "_b")).select(*keys, "unit", "x", "y", "_w")
    draws = draw_multiplicity(dup.select(*keys, "unit"), keys, reps, seed)
    r = dup.join(draws, [*keys, "unit"]).select(*keys, "x", "y", "_w", F.explode("draws").alias("_r"))
    m = F.col("_r.m") * F.col("_w")
    g = r.groupBy(*keys, F.col("_r.rep").alias("rep")).agg(
        F.sum(m).alias("s"), F.sum(m * F.col("x")).alias("sx"), F.sum(m * F.col("y")).alias("sy"),
        F.sum(m * F.col("x") * F.col("x")).alias("sxx"), F.sum(m * F.col("x") * F.col("y")).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    # a draw of one repeated row has no slope
    ok = F.abs(det) > 1e-12 * F.col("s") * F.col("sxx")
    slope = F.when(ok, (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    g = g.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s"))
    q = lambda c: F.percentile(c, [0.025, 0.975])
    return g.where("slope is not null").groupBy(*keys).agg(
        F.count("*").alias("draws"), q("slope").alias("_s"), q("intercept").alias("_i"),
        F.avg(F.when(F.col("slope") <= 0, 1.0).otherwise(0.0)).alias("p_slope_le_0")).select(
        *keys, "draws", F.col("_s")[0].alias("slope_lo"), F.col("_s")[1].alias("slope_hi"),
        F.col("_i")[0].alias("intercept_lo"), F.col("_i")[1].alias("intercept_hi"), "p_slope_le_0")
