"""Brute-force checks on small fixtures: fits, resampling, joins under skew, rasters, networks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import geometry as G
from panelwright.operators import clean, dependence, graph, meta, ppml, ranks, raster, resample, sample, spatial, specs, tables
from panelwright.operators.ppml import Spec

RNG = np.random.default_rng(3)


def small_panel(n_groups=12, size=9, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        a = r.normal()
        for i in range(1 if g == 0 else size):
            x1, x2, e = r.normal() + 0.3 * g, r.normal(), float(r.uniform(5, 50))
            y = 0 if g == 1 else int(r.poisson(e / 10 * math.exp(0.3 * a + 0.25 * x1 - 0.1 * x2)))
            rows.append((f"g{g:02d}", i, y, x1, x2, e, float(g % 3)))
    return rows


COLS = "GEOID string, i int, yc int, x1 double, x2 double, exposure double, flat double"


def dense_fit(rows, cols, weights=None):
    """Explicit group effects by plain Newton on the profile likelihood (numpy)."""
    g = np.array([r[0] for r in rows])
    y = np.array([r[2] for r in rows], float)
    x = np.array([[r[c] for c in cols] for r in rows], float)
    off = np.log([r[5] for r in rows])
    w = np.ones(len(y)) if weights is None else weights
    b = np.zeros(x.shape[1])
    names = np.unique(g)
    for _ in range(100):
        e = np.exp(x @ b + off)
        mu, xd = np.zeros_like(y), np.zeros_like(x)
        for k in names:
            m = g == k
            mu[m] = e[m] * (w[m] @ y[m]) / (w[m] @ e[m])
            xd[m] = x[m] - (w[m] * e[m]) @ x[m] / (w[m] @ e[m])
        h = xd.T @ (xd * (w * mu)[:, None]) + 1e-10 * np.eye(x.shape[1])
        step = np.linalg.solve(h, xd.T @ (w * (y - mu)))
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    s = np.array([((w * (y - mu))[g == k]) @ xd[g == k] for k in names])
    bread = np.linalg.inv(h)
    cov = bread @ (s.T @ s) @ bread * len(names) / (len(names) - 1)
    return b, np.sqrt(np.diag(cov)), mu


def test_absorbed_fit_matches_dense(spark):
    rows = small_panel()
    df = spark.createDataFrame(rows, COLS)
    fit = {r.model_id: r for r in ppml.ppml_fe(df, [Spec("two", "yc", ["x1", "x2"]), Spec("one", "yc", ["x1"]),
                                                    Spec("flat", "yc", ["x1", "flat"])], []).collect()}
    b, se, _ = dense_fit(rows, [3, 4])
    assert np.allclose(fit["two"].b, b, atol=1e-9) and np.allclose(fit["two"].bse, se, rtol=1e-8)
    b1, se1, _ = dense_fit(rows, [3])
    assert fit["one"].b[0] == pytest.approx(b1[0], abs=1e-9) and fit["one"].bse[0] == pytest.approx(se1[0], rel=1e-8)
    # a group-constant control is absorbed: slope unchanged, its own pinned at zero
    assert fit["flat"].b[0] == pytest.approx(b1[0], abs=1e-9) and fit["flat"].b[1] == 0.0
    r = fit["two"]
    assert (r.n_groups, r.n_singleton_groups, r.n_allzero_groups, r.converged) == (12, 1, 1, True)
    assert r.max_abs_score / r.events < 1e-8


def test_attenuation_path_works_the_sample_out_once(spark):
    """three fits read one sample."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.range(600).selectExpr("'a' AS city", "id % 40 AS GEOID", "pmod(xxhash64(id), 7) AS y", "pmod(xxhash64(id, 1), 100) / 50.0 AS x",
                                    "pmod(xxhash64(id, 2), 100) / 70.0 AS c", "1.0D + id % 3 AS exposure")
    got = specs.attenuation_path(d.mapInArrow(counted, d.schema), ["city"], "y", "x", ["c"]).collect()
    assert seen.value == 600
    alone = ppml.coef_row(ppml.ppml_fe(d, [Spec("m", "y", ["x", "c"])], ["city"])).first()
    assert [r.spec[:1] for r in sorted(got, key=lambda r: r.spec)] == ["1", "2", "3"]
    assert [(r.beta, r.se) for r in got if r.spec[0] == "3"] == [pytest.approx((alone.beta, alone.se))]


def test_fit_on_a_hot_group(spark):
    """One group with most of the rows gives the same answer as the dense fit."""
    rows = small_panel(8, 6) + [("g03", 100 + i, int(RNG.poisson(3)), float(RNG.normal()), float(RNG.normal()), 20.0, 0.0) for i in range(400)]
    fit = ppml.ppml_fe(spark.createDataFrame(rows, COLS).repartition(8), [Spec("m", "yc", ["x1", "x2"])], []).first()
    b, se, _ = dense_fit(rows, [3, 4])
    assert np.allclose(fit.b, b, atol=1e-9) and np.allclose(fit.bse, se, rtol=1e-8)


def test_weights_equal_relabelled_copies(spark):
    rows = small_panel(6, 7, seed=5)
    df = spark.createDataFrame(rows, COLS)
    d = ppml.centre_within(ppml.build_design(df, [Spec("m", "yc", ["x1"])], []), ["model_id"])
    m = {"g02": 3.0, "g03": 1.0, "g04": 2.0, "g05": 0.0}
    w = F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("grp"))
    wd = d.where(F.col("grp").isin("g02", "g03", "g04")).withColumn("w", w)
    got = ppml.newton_slopes(wd, ["model_id"]).first().b[0]
    copies = [(f"{r[0]}_{c}", *r[1:]) for r in rows for c in range(int(m.get(r[0], 0)))]
    assert got == pytest.approx(dense_fit(copies, [3])[0][0], abs=1e-10)


def test_draws_are_complete_and_repeatable(spark):
    u = spark.range(50).select(F.lit("c").alias("city"), F.col("id").cast("string").alias("unit"))
    a = resample.draw_multiplicity(u, ["city"], 20, 7).select("unit", F.explode("draws").alias("d")).select("unit", "d.*")
    per = {r.rep: r.n for r in a.groupBy("rep").agg(F.sum("m").alias("n")).collect()}
    assert per == {i: 50.0 for i in range(20)}
    b = resample.draw_multiplicity(u.repartition(3), ["city"], 20, 7).select("unit", F.explode("draws").alias("d")).select("unit", "d.*")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_bootstrap_spread_tracks_the_clustered_error(spark):
    rows = small_panel(40, 12, seed=9)
    df = spark.createDataFrame(rows, COLS).withColumn("yb", F.col("yc") + F.col("i") % 3)
    base = ppml.coef_row(ppml.ppml_fe(df, [Spec("a", "yc", ["x1"])], [])).first()
    s = resample.bootstrap_slopes(df, [Spec("a", "yc", ["x1"])], [], F.col("GEOID"), 200, 17)
    sd = s.agg(F.stddev_samp("beta")).first()[0]
    assert 0.7 < sd / base.se < 1.4
    r = resample.cluster_bootstrap_diff(df, Spec("a", "yc", ["x1"]), Spec("b", "yb", ["x1"]), [], reps=60).first()
    assert r.n_boot_ok == 60 and r.diff_lo < r.diff_beta < r.diff_hi


def test_relabelling_keeps_every_incident(spark):
    counts = spark.createDataFrame([(c, p, 5 + c % 4) for c in range(200) for p in ("A", "B")], "cell int, pred string, n int")
    conf = spark.createDataFrame([("A", "A", 0.7), ("A", "B", 0.3), ("B", "B", 1.0)], "pred string, truth string, p double")
    d = resample.relabel_draws(counts, conf, ["cell"], 10, 1)
    tot = counts.agg(F.sum("n")).first()[0]
    by = {(r.rep, r.truth): r.n for r in d.groupBy("rep", "truth").agg(F.sum("n").alias("n")).collect()}
    assert all(by[(i, "A")] + by[(i, "B")] == tot for i in range(10))
    share = np.mean([by[(i, "A")] for i in range(10)]) / (tot / 2)
    assert abs(share - 0.7) < 0.03


def test_percentiles_and_ranks_exact(spark):
    vals = [(k, float(v)) for k in "ab" for v in RNG.integers(0, 40, 700 if k == "a" else 5)]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {r.k: r for r in ranks.exact_percentiles(df, ["k"], "v", [0.0, 0.003, 0.5, 0.997, 1.0], list("pqrst")).collect()}
    for k in "ab":
        x = [v for kk, v in vals if kk == k]
        assert [got[k][c] for c in "pqrst"] == pytest.approx(list(np.percentile(x, [0, 0.3, 50, 99.7, 100])))
    big = df.where("k = 'a'").crossJoin(spark.range(60).withColumnRenamed("id", "c")).withColumn("v", F.col("v") + F.col("c") / 7.0)
    x = np.array([r.v for r in big.select("v").collect()])
    got = ranks.exact_percentiles(big, [], "v", [0.003, 0.25, 0.5, 0.997], list("pqrs")).first()
    assert [got[c] for c in "pqrs"] == pytest.approx(list(np.percentile(x, [0.3, 25, 50, 99.7])))
    r = {(x.k, x.v): x.rk for x in ranks.average_rank(df, ["k"], "v", "rk").collect()}
    for k in "ab":
        x = np.array([v for kk, v in vals if kk == k])
        assert all(r[(k, v)] == (x < v).sum() + ((x == v).sum() + 1) / 2 for v in x)
    n = ranks.dense_index(spark.range(997).withColumn("k", F.col("id") % 3), ["k"], F.xxhash64("id")).groupBy("k").agg(
        F.sort_array(F.collect_list("idx")).alias("i")).collect()
    assert all(list(x.i) == list(range(len(x.i))) for x in n)


@pytest.mark.parametrize("cap", [1, 7, 50, 1000])
def test_cap_recent_with_ties(spark, cap):
    rows = [("hot" if i % 3 else "cold", i, f"2024-01-{1 + (i * 7) % 4:02d} 10:00:{(i // 9) % 3:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "feed string, id int, t string").withColumn("ts", F.to_timestamp("t"))
    got = {(r.feed, r.id) for r in clean.cap_recent(df, "feed", "ts", "id", cap).collect()}
    want = set()
    for f in ("hot", "cold"):
        mine = sorted([r for r in rows if r[0] == f], key=lambda r: r[1])
        want |= {(f, r[1]) for r in sorted(mine, key=lambda r: r[2], reverse=True)[:cap]}
    assert got == want


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r.v for r in sample.nan_to_null(df).collect()] == [1.0, None, None]
    assert df.select(sample.floor_log(F.col("v"), 5.0).alias("l")).collect()[2].l is None


def test_grid_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-40.0, 1040.0), (-140.0, 500.0), (50.0, 999.0), (250.0, 0.5), (310.0, 500.0)], "x double, y double")
    got = tables.grid_bin(df, F.col("x"), F.col("y"), 0.0, 1000.0, 100.0, 3, 10).collect()
    assert [(r.row, r.col, r.cell) for r in got] == [(0, 0, 0), (0, 0, 0), (9, 2, 29)]


def test_knn_with_a_crowd(spark):
    """A third of all points on one spot, a dense cluster and far outliers."""
    pts = [(i, 5.0, 5.0) for i in range(120)] + [(200 + i, float(RNG.normal(50, 0.01)), float(RNG.normal(50, 0.01))) for i in range(120)]
    pts += [(400 + i, float(RNG.uniform(0, 5000)), float(RNG.uniform(0, 5000))) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {}
    for r in spatial.knn_join(df, 5).collect():
        got.setdefault(r.i, []).append((r.rank, r.j))
    a = np.array([(p[1], p[2]) for p in pts])
    for n, (i, x, y) in enumerate(pts):
        d = np.hypot(a[:, 0] - x, a[:, 1] - y)
        order = [pts[m][0] for m in sorted(range(len(pts)), key=lambda m: (d[m], pts[m][0])) if m != n][:5]
        assert [j for _, j in sorted(got[i])] == order


def test_salted_join_splits_and_keeps_all(spark):
    l = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).alias("k"))
    r = spark.range(40).select(F.col("id").alias("rid"), (F.col("id") % 5).alias("k"))
    a, b = spatial.salted_join(l, r, ["k"], "id", rows_per_task=50), l.join(r, "k")
    assert a.select("id", "rid").exceptAll(b.select("id", "rid")).isEmpty() and a.count() == b.count()


def test_radius_sum_counts_a_crowd(spark):
    pts = [(i, 0.0, 0.0) for i in range(300)] + [(300 + i, float(RNG.uniform(-300, 300)), float(RNG.uniform(-300, 300))) for i in range(200)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    q = df.where("id >= 290")
    got = {r.id: r.n for r in spatial.radius_sum(q, df.select("x", "y"), 100.0).collect()}
    for i, x, y in pts[290:]:
        assert got[i] == sum(math.hypot(x - u, y - v) <= 100.0 for _, u, v in pts)


def test_geometry(spark):
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    u = [(0, 0), (6, 0), (6, 5), (5, 5), (5, 1), (1, 1), (1, 5), (0, 5)]
    arr = lambda r: F.array(*[G.point(x, y) for x, y in r])
    d = spark.range(1).select(F.lit(1).alias("k"), arr(ell).alias("ring"))
    d = d.unionByName(spark.range(1).select(F.lit(2).alias("k"), arr(u).alias("ring")))
    d = G.with_representative_point(d).withColumn("in", G.in_ring(F.col("px"), F.col("py"), F.col("ring"))).withColumn("a", G.ring_area(F.col("ring")))
    got = {r.k: r for r in d.collect()}
    assert got[1]["in"] and got[2]["in"] and got[1].a == 7 and got[2].a == 14
    b = spark.range(1).select(F.lit(1).alias("b"), arr(ell).alias("ring"))
    ov = {(r.row_, r.col_): r.frac for r in spatial.area_overlay(b, 2.0, 1.0, 3.0).collect()}
    assert ov == {(1, 0): pytest.approx(3 / 7), (1, 1): pytest.approx(2 / 7), (0, 0): pytest.approx(2 / 7)}


def test_slope_matches_array_gradient(spark):
    z = RNG.uniform(0, 30, (23, 31))
    z[5, 7] = np.nan
    rows = [(0, r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(23) for c in range(31)]
    px = spark.createDataFrame(rows, "raster_id int, row int, col int, z double")
    gy, gx = np.gradient(z, 10.0, 10.0)
    want = np.where(np.isfinite(z), np.degrees(np.arctan(np.hypot(gx, gy))), np.nan)
    for r in raster.slope_deg(px, 10.0, tile=8).collect():
        w = want[r.row, r.col]
        assert (r.slope_deg is None and np.isnan(w)) or r.slope_deg == pytest.approx(w, abs=1e-9)


def brute_betweenness(arcs, nodes):
    out, n = {}, len(nodes)
    for s in nodes:
        dist, sig, order = {s: 0.0}, {s: 1.0}, []
        todo = {s: 0.0}
        while todo:
            u = min(todo, key=todo.get)
            du = todo.pop(u)
            order.append(u)
            for (a, b), w in arcs.items():
                if a == u:
                    if b not in dist or du + w < dist[b]:
                        dist[b], sig[b] = du + w, sig[u]
                        todo[b] = dist[b]
                    elif du + w == dist[b] and b not in order:
                        sig[b] += sig[u]
        delta = {u: 0.0 for u in order}
        for v in reversed(order):
            for (a, b), w in arcs.items():
                if b == v and a in dist and dist[a] + w == dist[v]:
                    c = sig[a] / sig[v] * (1 + delta[v])
                    out[frozenset((a, b))] = out.get(frozenset((a, b)), 0) + c
                    delta[a] += c
    return {k: v / (n * (n - 1)) for k, v in out.items()}


def test_edge_betweenness_exact(spark):
    arcs = {}
    for u, v in itertools.permutations(range(9), 2):
        if abs(u - v) in (1, 3) and (u + v) % 7 != 0:
            arcs[(u, v)] = float(1 + (u * v) % 3)
    e = spark.createDataFrame([(0, u, v, 0, w, w) for (u, v), w in arcs.items()], "net int, src long, dst long, key int, length double, travel_time double")
    n = spark.createDataFrame([(0, i, 0.0, 0.0) for i in range(9)], "net int, node long, x double, y double")
    want = brute_betweenness(arcs, range(9))
    for r in graph.edge_betweenness(e, n).collect():
        assert r.betweenness == pytest.approx(want.get(frozenset((r.lo, r.hi)), 0.0), abs=1e-12)


def test_edge_betweenness_by_regions(spark, monkeypatch):
    monkeypatch.setattr(graph, "REGION", 2)
    monkeypatch.setattr(graph, "BLOCK", 4)
    test_edge_betweenness_exact(spark)
    monkeypatch.undo()
    # a street of 300 nodes settles in as many rounds as it has regions, and pairs out of reach have no row
    both = [(net, a, b, 0, 1.0, 1.0) for net in (0, 1) for u in range(299) if not (net and u == 149) for a, b in ((u, u + 1), (u + 1, u))]
    e = spark.createDataFrame(both, "net int, src long, dst long, key int, length double, travel_time double")
    n = spark.createDataFrame([(net, i, 0.0, 0.0) for net in (0, 1) for i in range(300)], "net int, node long, x double, y double")
    for r in graph.edge_betweenness(e, n, max_rounds=8).collect():
        left, right = (r.hi, 300 - r.hi) if r.net == 0 else (r.hi % 150, 150 - r.hi % 150)
        assert r.betweenness == pytest.approx(2 * left * right / (300 * 299), abs=1e-12)


def test_knn_reads_its_points_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def column(i):
        seen.add(1)
        return float(i % 20)
    pts = spark.range(400).select("id", column("id").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    got = spatial.knn_join(pts, 4).where("i = 210 or i = 0").collect()
    assert sorted((r.i, r.rank, r.j) for r in got) == [(0, 1, 1), (0, 2, 20), (0, 3, 21), (0, 4, 2), (210, 1, 190), (210, 2, 209), (210, 3, 211), (210, 4, 230)]
    assert seen.value == 400


def test_unsettled_values_are_told(spark, monkeypatch):
    r = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(40, 2)))], "id bigint, x double, y double")
    with pytest.raises(RuntimeError, match="residuals"):
        dependence.moran_eigenvectors(pts.select("id"), dependence.knn_weights(pts, 4), k=2, tol=1e-15, restarts=1, steps=2)
    monkeypatch.setattr(meta, "MAX_STEPS", 1)
    pools = spark.createDataFrame([("a", float(b), 0.1) for b in r.normal(size=8)], "pool string, beta double, se double")
    with pytest.raises(RuntimeError, match="not settled"):
        meta.tau2_all(pools, ["pool"])


def test_moran_eigenvalues(spark):
    pts = spark.createDataFrame([(i, float(RNG.uniform(0, 100)), float(RNG.uniform(0, 100))) for i in range(60)], "id int, x double, y double")
    w = dependence.knn_weights(pts, 4).cache()
    c = np.zeros((60, 60))
    for r in w.collect():
        c[r.i, r.j] = r.w
    c = (c + c.T) / 2
    m = np.eye(60) - 1 / 60
    a = m @ c @ m
    ev = np.linalg.eigvalsh(a)
    ev = np.sort(np.delete(ev, np.argmin(np.abs(ev))))[::-1]       # constants, which centring takes away, are no pattern
    for k, have in ((2, 2), (200, 59)):
        vals, vecs = dependence.moran_eigenvectors(pts.select("id"), w, k=k)
        lam = np.array([r.lam for r in vals.orderBy("vec").collect()])
        assert len(lam) == have and np.allclose(lam, ev[:have], atol=1e-9)
        v = np.zeros((60, have))
        for r in vecs.collect():
            v[r.id] = r.v
        assert np.linalg.norm(a @ v - v * lam, axis=0).max() <= 2e-6 and np.allclose(v.T @ v, np.eye(have), atol=1e-8)
    none, _ = dependence.moran_eigenvectors(pts.select("id").limit(0), w.limit(0), k=2)
    assert none.count() == 0
    big = dependence.morans_i(pts.select("id", F.col("x").alias("e")), w, permutations=49).first()
    assert big.morans_i > 0.3 and big.p_sim == pytest.approx(1 / 50) and big.p_norm < 0.01


def test_checkpoint_folder_is_the_cluster_one(spark):
    from panelwright.session import shared_dir
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_logs_at_and_below_zero(spark):
    from panelwright.functions.stats import ln
    v = spark.createDataFrame([(x,) for x in (0.0, -0.0, -1.0, -2.0, 1.0, math.nan, None)], "v double")
    got = v.select(ln(F.col("v")).alias("a"), ln(F.col("v"), 1.0).alias("b")).collect()
    inf, nan = math.inf, math.nan
    want = [(-inf, 0.0), (-inf, 0.0), (nan, -inf), (nan, nan), (0.0, math.log(2.0)), (nan, nan), (None, None)]
    assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, nan_ok=True)) for r, w in zip(got, want) for x, y in zip(r, w))


def test_math_functions_of_zero(spark, tmp_path):
    import __spark_entry__ as entry
    from harness import compare
    import duckdb
    duckdb.sql(f"COPY (SELECT range::BIGINT AS event_id, [0.0, 0.01, -0.5, 560.2, NULL][range + 1]::DOUBLE AS value FROM range(5)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert compare(entry.queries()["math_functions"](spark, str(tmp_path)), con, entry.oracle_sql()["math_functions"]) is None


def test_bucketed_joins_never_broadcast_repeated_rows(spark):
    """The planner takes a repeated row for one: ten megabytes of its estimate may be gigabytes on the driver."""
    line = F.array(G.point(F.col("id") * 10.0, F.lit(0.0)), G.point(F.col("id") * 10.0 + 8, F.lit(5.0)))
    lines = spark.range(200).select(F.col("id").alias("seg_id"), line.alias("line"), F.lit(1.0).alias("value"))
    q = spark.range(50).select("id", (F.col("id") * 10.0).alias("x"), F.lit(3.0).alias("y"))
    edge = [spatial.line_length_in_disk(q, lines, 40.0), spatial.ring_cross_count(q, lines, 40.0),
            spatial.buffer_count_len(lines.select("seg_id", "line"), lines.select(F.col("seg_id").alias("way_id"), "line"), 20.0)]
    for d in edge:
        plan = d._jdf.queryExecution().sparkPlan().toString()
        joins = [x for x in plan.splitlines() if "_bx" in x and "Join" in x]
        assert joins and not [x for x in joins if "Broadcast" in x and "_n" not in x and "LeftOuter" not in x], plan


def test_buffer_takes_each_pair_once_at_the_rim(spark):
    rows = [(i, [(float(x), float(y)), (float(x + dx), float(y + dy))]) for i, (x, y, dx, dy) in enumerate(
        [tuple(RNG.integers(-300, 300, 2)) + tuple(RNG.integers(-900, 900, 2)) for _ in range(40)] + [(0, 0, 50, 0), (0, 100, 50, 0)])]
    d = spark.createDataFrame(rows, "seg_id int, line array<struct<x:double,y:double>>")
    got = {r.seg_id: (r.n_within, r.len_within) for r in spatial.buffer_count_len(d, d.withColumnRenamed("seg_id", "way_id"), 100.0).collect()}
    every = d.alias("a").join(d.alias("b").withColumnRenamed("seg_id", "way_id").withColumnRenamed("line", "_w"), how="cross").where(
        G.line_line_distance(F.col("line"), F.col("_w")) <= 100.0).groupBy("seg_id").agg(F.count("*").alias("n"), F.sum(G.line_length(F.col("_w"))).alias("l")).collect()
    assert len(got) == len(every) and all(got[r.seg_id][0] == r.n and got[r.seg_id][1] == pytest.approx(r.l) for r in every)
    assert got[40][0] >= 2


def test_let_go_deletes_shuffle_files(spark):
    import time
    from panelwright.session import let_go
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    let_go(spark)
    time.sleep(2)
    before = disk.getAllFiles().size()
    def work():
        d = spark.range(100_000).repartition(8, "id").groupBy((F.col("id") % 1000).alias("k")).count()
        return len(d.collect())
    assert work() == 1000
    made = disk.getAllFiles().size()
    for _ in range(8):
        let_go(spark)
        time.sleep(0.5)
    assert made > before and disk.getAllFiles().size() <= before
