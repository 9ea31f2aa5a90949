"""Pooling study estimates: fixed and random effects, leave-one-out, regressions, equivalence.

Any number of pools (outcome, spec, left-out study, replicate are just key
columns) is solved together.  The between-study variances are found by Newton
steps; each step is one grouped sum over the studies of all pools, so even a
pool of very many studies is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.stats import chi2_cdf, chi2_ppf, norm_cdf, norm_ppf, pct, t_cdf, t_ppf
from panelwright.operators.ppml import BROADCAST_MODELS
from panelwright.operators.ranks import with_group
from panelwright.operators.tables import div
from panelwright.session import cut

NEGLIGIBLE_PCT = 5.0
TAU_TOL = 1e-13
MAX_STEPS = 500


def usable(df: DataFrame, y: str, s: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok(y) & ok(s) & (F.col(s) > 0))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def _centred(df: DataFrame, keys: list[str], y: str, s: str, *more: str) -> DataFrame:
    d = usable(df, y, s).select(*keys, F.col(y).alias("y"), F.col(s).alias("s"), *more)
    return with_group(d, keys, m0=F.avg("y")).withColumn("yc", F.col("y") - F.col("m0"))


def pool_fixed(df: DataFrame, keys: list[str], y: str = "beta", s: str = "se") -> DataFrame:
    """Inverse-variance pool with Q, I-squared and the negligible flag."""
    df, k = _keyed(df, keys)
    d = _centred(df, k, y, s).withColumn("w", 1 / (F.col("s") * F.col("s")))
    g = d.groupBy(*k).agg(F.count("*").alias("k"), F.first("m0").alias("m0"), F.sum("w").alias("sw"),
                          F.sum(F.col("w") * F.col("yc")).alias("b"), F.sum(F.col("w") * F.col("yc") * F.col("yc")).alias("c"))
    mu = F.col("m0") + F.col("b") / F.col("sw")
    se = F.sqrt(1 / F.col("sw"))
    g = g.withColumns({"mu": mu, "se": se, "Q": F.greatest(F.col("c") - F.col("b") * F.col("b") / F.col("sw"), F.lit(0.0))})
    free = F.greatest(F.col("k") - 1, F.lit(1))
    i2 = F.when(F.col("Q") > 0, F.greatest((F.col("Q") - free) / F.col("Q"), F.lit(0.0))).otherwise(0.0)
    z = norm_ppf(0.975)
    return g.select(*keys, "k", "mu", "se", "Q", i2.alias("I2"), pct(F.col("mu")).alias("pooled_pct"),
                    pct(F.col("mu") - 1.96 * F.col("se")).alias("lo"), pct(F.col("mu") + 1.96 * F.col("se")).alias("hi"),
                    pct(F.col("mu") - z * F.col("se")).alias("fe_lo"), pct(F.col("mu") + z * F.col("se")).alias("fe_hi"),
                    (F.col("mu") / F.col("se")).alias("z"),
                    (F.abs(pct(F.col("mu"))) < NEGLIGIBLE_PCT).alias("substantively_negligible"))


def _q_sums(t: str, tag: str) -> list[Column]:
    w = 1 / (F.col("s") * F.col("s") + F.col(t))
    yc = F.col("yc")
    return [F.sum(w).alias(f"A{tag}"), F.sum(w * yc).alias(f"B{tag}"), F.sum(w * yc * yc).alias(f"C{tag}"),
            F.sum(w * w).alias(f"D{tag}"), F.sum(w * w * yc).alias(f"E{tag}"), F.sum(w * w * yc * yc).alias(f"G{tag}")]


def _q_of(tag: str) -> Column:
    return F.col(f"C{tag}") - F.col(f"B{tag}") * F.col(f"B{tag}") / F.col(f"A{tag}")


def _spread(tag: str) -> Column:
    """Sum of w^2 (y - mu)^2, which is minus the slope of Q."""
    mu = F.col(f"B{tag}") / F.col(f"A{tag}")
    return F.col(f"G{tag}") - 2 * mu * F.col(f"E{tag}") + mu * mu * F.col(f"D{tag}")


def _q_step(t: str, tag: str, target: Column) -> Column:
    """Newton on 1/Q, which is nearly a straight line in the variance; zero when Q(0) is below target."""
    q = _q_of(tag)
    return F.greatest(F.col(t) + F.coalesce(div(q * (div(q, target) - 1), _spread(tag)), F.lit(0.0)), F.lit(0.0))


def tau2_all(df: DataFrame, keys: list[str], y: str = "beta", s: str = "se", level: float = 0.95) -> DataFrame:
    """DerSimonian-Laird, REML, Paule-Mandel and the Q-profile bounds of every pool, with base sums."""
    d = _centred(df, keys, y, s).persist()
    try:
        w = 1 / (F.col("s") * F.col("s"))
        g = d.groupBy(*keys).agg(
            F.count("*").alias("k"), F.first("m0").alias("m0"), F.sum(w).alias("A"), F.sum(w * w).alias("A2"),
            F.sum(w * F.col("yc")).alias("B"), F.sum(w * F.col("yc") * F.col("yc")).alias("C"))
        g = g.withColumn("Q", F.greatest(F.col("C") - F.col("B") * F.col("B") / F.col("A"), F.lit(0.0)))
        free, denom = F.col("k") - 1, F.col("A") - F.col("A2") / F.col("A")
        g = g.withColumn("tau2_dl", F.when((free > 0) & (denom > 0), F.greatest((F.col("Q") - free) / denom, F.lit(0.0))).otherwise(0.0))
        g = g.withColumn("typical", div(free * F.col("A"), F.when(F.col("k") > 1, F.col("A") * F.col("A") - F.col("A2"))))
        a = (1 - level) / 2
        g = g.withColumn("c_lo", chi2_ppf(1 - a, free)).withColumn("c_hi", chi2_ppf(a, free))
        base = cut(g)
        n = base.count()
        state = base.select(*keys, "k", "c_lo", "c_hi", F.col("tau2_dl").alias("t1"),
                            *[F.lit(0.0).alias(t) for t in ("t2", "t3", "t4")], F.lit(False).alias("done"))
        many = F.col("k") >= 2
        profile = F.col("k") >= 3
        w1 = 1 / (F.col("s") * F.col("s") + F.col("t1"))
        sums = (_q_sums("t1", "1") + [F.sum(w1 * w1 * w1).alias("H1")] + _q_sums("t2", "2") + _q_sums("t3", "3")
                + _q_sums("t4", "4"))
        # REML score and expected information
        trace = F.col("A1") - F.col("D1") / F.col("A1")
        info = F.col("D1") - 2 * F.col("H1") / F.col("A1") + (F.col("D1") / F.col("A1")) ** 2
        reml = F.greatest(F.col("t1") + F.coalesce(div(_spread("1") - trace, info), F.lit(0.0)), F.lit(0.0))
        new = {"n1": F.when(many, reml).otherwise(0.0), "n2": F.when(many, _q_step("t2", "2", F.col("k") - 1)).otherwise(0.0),
               "n3": F.when(profile, _q_step("t3", "3", F.col("c_lo"))).otherwise(0.0),
               "n4": F.when(profile, _q_step("t4", "4", F.col("c_hi")))}
        still = reduce(lambda p, q: p & q, [
            F.coalesce(F.abs(F.col(f"n{i}") - F.col(f"t{i}")) <= TAU_TOL * F.greatest(F.col(f"t{i}"), F.lit(1e-3)), F.lit(True))
            for i in range(1, 5)])
        finished = []
        for step in range(MAX_STEPS):
            small = F.broadcast(state) if n <= BROADCAST_MODELS else state
            r = d.join(small, keys).groupBy(*keys, "k", "c_lo", "c_hi", "t1", "t2", "t3", "t4").agg(*sums).withColumns(new)
            r = r.withColumn("done", still)
            state = cut(r.select(*keys, "k", "c_lo", "c_hi", *[F.col(f"n{i}").alias(f"t{i}") for i in range(1, 5)], "done"))
            open_ = state.where("not done").count()
            if open_ < n or open_ == 0:
                finished.append(state.where("done"))
            state, n = state.where("not done"), open_
            if open_ == 0:
                break
        else:
            raise RuntimeError(f"variances of {n} pools not settled after {MAX_STEPS} steps")
        fin = reduce(lambda p, q: p.unionByName(q), finished)
        return base.join(fin.select(*keys, F.col("t1").alias("tau2"), F.col("t2").alias("tau2_pm"),
                                    F.when(profile, F.col("t3")).otherwise(0.0).alias("tau2_lo"), F.col("t4").alias("tau2_hi")), keys)
    finally:
        d.unpersist()


def pool_random(df: DataFrame, keys: list[str], y: str = "beta", s: str = "se", level: float = 0.95) -> DataFrame:
    """REML pool with Hartung-Knapp and normal intervals, heterogeneity and a prediction interval."""
    df, k = _keyed(df, keys)
    tau = tau2_all(df, k, y, s, level)
    d = _centred(df, k, y, s)
    w = 1 / (F.col("s") * F.col("s") + F.col("tau2"))
    g = d.join(tau.select(*k, "tau2"), k).groupBy(*k).agg(
        F.sum(w).alias("sw"), F.sum(w * F.col("yc")).alias("sb"), F.sum(w * F.col("yc") * F.col("yc")).alias("sc"),
        F.first("y").alias("y1"), F.first("s").alias("s1"))
    g = g.join(tau, k)
    one, a, z = F.col("k") == 1, (1 - level) / 2, norm_ppf(1 - (1 - level) / 2)
    free = F.col("k") - 1
    g = g.withColumn("mu", F.col("m0") + F.col("sb") / F.col("sw")).withColumn("se", F.sqrt(1 / F.col("sw")))
    q_hk = F.greatest(div(F.col("sc") - F.col("sb") * F.col("sb") / F.col("sw"), free), F.lit(1e-12))
    g = g.withColumn("se_hk", F.when(one, F.col("se")).otherwise(F.col("se") * F.sqrt(q_hk)))
    g = g.withColumn("_t1", t_ppf(1 - a, free)).withColumn("_t2", t_ppf(1 - a, F.col("k") - 2))
    half = F.when(one, z * F.col("se")).otherwise(F.col("_t1") * F.col("se_hk"))
    pred = F.when(F.col("k") >= 3, F.col("_t2") * F.sqrt(F.col("tau2") + F.col("se") * F.col("se")))
    i2 = lambda t: div(F.col(t), F.col(t) + F.col("typical"))
    total = F.col("tau2") + F.col("typical")
    out = g.withColumns({
        "lo": F.col("mu") - half, "hi": F.col("mu") + half,
        "lo_normal": F.col("mu") - z * F.col("se"), "hi_normal": F.col("mu") + z * F.col("se"),
        "pi_lo": F.col("mu") - pred, "pi_hi": F.col("mu") + pred, "tau": F.sqrt("tau2"),
        "I2": F.when(one, 0.0).otherwise(F.when(total > 0, F.col("tau2") / total).otherwise(0.0)),
        "I2_lo": F.when(~one, i2("tau2_lo")), "I2_hi": F.when(~one, i2("tau2_hi")),
        "Q_p": F.when(~one, 1 - chi2_cdf(F.col("Q"), free)),
        "method": F.when(one, "single").otherwise("REML + Hartung-Knapp")})
    for c in ("mu", "lo", "hi", "lo_normal", "hi_normal", "pi_lo", "pi_hi"):
        out = out.withColumn("pct" if c == "mu" else f"pct_{c}", pct(F.col(c)))
    cols = ["k", "mu", "se", "se_hk", "lo", "hi", "lo_normal", "hi_normal", "tau2", "tau", "tau2_dl", "tau2_pm", "tau2_lo", "tau2_hi",
            "I2", "I2_lo", "I2_hi", "Q", "Q_p", "pi_lo", "pi_hi", "pct", "pct_lo", "pct_hi", "pct_lo_normal", "pct_hi_normal",
            "pct_pi_lo", "pct_pi_hi", "method"]
    return out.select(*keys, *cols)


def leave_one_out(df: DataFrame, keys: list[str], study: str, y: str = "beta", s: str = "se") -> DataFrame:
    """Each pool refitted without each study: the left-out study is one more key."""
    d, k = _keyed(usable(df, y, s), keys)
    d = d.select(*k, F.col(study).alias("_study"), F.col(y).alias("y"), F.col(s).alias("s"))
    left = d.select(*k, F.col("_study").alias("dropped"))
    e = d.join(left, k).where(F.col("_study") != F.col("dropped"))
    r = pool_random(e, [*k, "dropped"], "y", "s")
    return r.select(*keys, "dropped", "k", "pct", F.col("pct_lo").alias("lo"), F.col("pct_hi").alias("hi"), "tau2", "I2")


def _regress(p: int, with_tau: bool):
    def run(batches):
        for pdf in batches:
            rows = {c: [] for c in ("b", "inv", "qe", "t2")}
            for xx, xy, yy, xx2, sw, k in zip(pdf["xx"], pdf["xy"], pdf["yy"], pdf["xx2"], pdf["sw"], pdf["k"]):
                tri = np.tril_indices(p)
                full = lambda v: (lambda m: m + np.tril(m, -1).T)(_fill(v, p, tri))
                xx, xx2, xy = full(np.asarray(xx, float)), full(np.asarray(xx2, float)), np.asarray(xy, float)
                inv = np.linalg.pinv(xx)
                b = inv @ xy
                qe = max(float(yy - b @ xy), 0.0)
                tr = float(sw - np.trace(inv @ xx2))
                t2 = max(0.0, (qe - (k - p)) / tr) if k > p and tr > 0 else 0.0
                for c, v in zip(rows, (list(b), list(inv.ravel()), qe, t2)):
                    rows[c].append(v)
            out = pdf.drop(columns=["xx", "xy", "yy", "xx2", "sw"])
            for c, v in rows.items():
                out[c] = v
            yield out
    return run


def _fill(v, p, tri):
    m = np.zeros((p, p))
    m[tri] = v
    return m


def meta_regression(df: DataFrame, keys: list[str], x: list[str], y: str = "beta", s: str = "se", level: float = 0.95) -> DataFrame:
    """Random-effects regression on moderators: moment variance, Knapp-Hartung errors, one row per term."""
    df, k = _keyed(df, keys)
    d = _centred(df, k, y, s, *x).persist()
    names, p = ["intercept", *x], len(x) + 1
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in x]
    types = dict(d.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in k) + ", k bigint, m0 double, b array<double>, inv array<double>, qe double, t2 double"

    def fit(rows):
        w = 1 / (F.col("s") * F.col("s") + F.col("_t2"))
        tri = [(i, j) for i in range(p) for j in range(i + 1)]
        g = rows.groupBy(*k).agg(
            F.count("*").alias("k"), F.first("m0").alias("m0"),
            F.array(*[F.sum(w * xs[i] * xs[j]) for i, j in tri]).alias("xx"),
            F.array(*[F.sum(w * xs[i] * F.col("yc")) for i in range(p)]).alias("xy"),
            F.sum(w * F.col("yc") * F.col("yc")).alias("yy"),
            F.array(*[F.sum(w * w * xs[i] * xs[j]) for i, j in tri]).alias("xx2"), F.sum(w).alias("sw"))
        return g.mapInPandas(_regress(p, True), schema)

    try:
        first = fit(d.withColumn("_t2", F.lit(0.0))).select(*k, F.col("t2").alias("_t2"))
        first = cut(first)
        second = fit(d.join(first, k)).join(first, k).drop("t2")
        null = tau2_all(df, k, y, s, level).select(*k, F.col("tau2").alias("tau2_null"))
        r = cut(second.join(null, k))
    finally:
        d.unpersist()
    free = F.col("k") - p
    r = r.withColumn("_scale", F.when(free > 0, F.greatest(F.col("qe") / free, F.lit(1e-12))).otherwise(1.0))
    r = r.withColumn("Qe_p", F.when(free > 0, 1 - chi2_cdf(F.col("qe"), free)))
    r = r.withColumn("R2", F.when(F.col("tau2_null") > 0, F.greatest(1 - F.col("_t2") / F.col("tau2_null"), F.lit(0.0))))
    terms = F.array(*[F.struct(
        F.lit(n).alias("term"), (F.get("b", F.lit(i)) + (F.col("m0") if i == 0 else F.lit(0.0))).alias("beta"),
        F.sqrt(F.get("inv", F.lit(i * p + i)) * F.col("_scale")).alias("se")) for i, n in enumerate(names)])
    r = r.select(*k, "k", F.col("_t2").alias("tau2_resid"), "tau2_null", "R2", F.col("qe").alias("Qe"), "Qe_p", F.explode(terms).alias("_t")).select(
        *k, "_t.*", "k", "tau2_resid", "tau2_null", "R2", "Qe", "Qe_p")
    z = norm_ppf(1 - (1 - level) / 2)
    r = r.withColumn("t", div(F.col("beta"), F.col("se"))).withColumn("_c", F.coalesce(t_ppf(1 - (1 - level) / 2, F.col("k") - p), F.lit(z)))
    pt = F.when(F.col("k") > p, 2 * (1 - t_cdf(F.abs("t"), F.col("k") - p))).otherwise(2 * (1 - norm_cdf(F.abs("t"))))
    r = r.withColumns({"p": pt, "lo": F.col("beta") - F.col("_c") * F.col("se"), "hi": F.col("beta") + F.col("_c") * F.col("se")})
    return r.withColumns({"pct": pct(F.col("beta")), "pct_lo": pct(F.col("lo")), "pct_hi": pct(F.col("hi"))}).drop("_c", *([] if keys else ["_all"]))


def prediction_grid(terms: DataFrame, observed: DataFrame, x: str, points: int = 60) -> DataFrame:
    """Fitted percent effect on an even grid across the observed moderator (one moderator)."""
    b = terms.agg(F.max(F.when(F.col("term") == "intercept", F.col("beta"))).alias("b0"),
                  F.max(F.when(F.col("term") == x, F.col("beta"))).alias("b1"))
    span = observed.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    one = b.withColumn("_k", F.lit(1)).join(F.broadcast(span.withColumn("_k", F.lit(1))), "_k")
    g = one.select("b0", "b1", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    v = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    return g.select("i", v.alias(x), pct(F.col("b0") + F.col("b1") * v).alias("pct"))


def wls_line(df: DataFrame, keys: list[str], x: str, y: str = "beta", s: str = "se") -> DataFrame:
    """Weighted line with residual-scaled errors and the weighted mean: closed form, centred twice."""
    df, k = _keyed(df, keys)
    d = usable(df, y, s).where(F.col(x).isNotNull()).withColumn("_w", 1 / (F.col(s) * F.col(s)))
    avg = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
    d = with_group(d, k, _mx=avg(x), _my=avg(y))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sm = lambda e: F.sum(F.col("_w") * e)
    g = d.groupBy(*k).agg(F.count("*").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.sum("_w").alias("sw"),
                          sm(dx * dx).alias("xx"), sm(dx * dy).alias("xy"), sm(dy * dy).alias("yy"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    slope = div(F.col("xy"), F.col("xx"))
    s2 = F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))
    b0 = F.col("my") - slope * F.col("mx")
    return g.select(*keys, "n", "x_min", "x_max", b0.alias("intercept"), slope.alias("slope"),
                    F.sqrt(s2 * (1 / F.col("sw") + div(F.col("mx") * F.col("mx"), F.col("xx")))).alias("intercept_se"),
                    F.sqrt(div(s2, F.col("xx"))).alias("slope_se"), pct(b0).alias("intercept_pct"), pct(F.col("my")).alias("naive_mean_pct"))


def tost(df: DataFrame, diff: str, se: str, margin: Column, level: float = 0.90) -> DataFrame:
    """Two one-sided tests of |diff| < margin, with the matching interval."""
    z = norm_ppf(1 - (1 - level) / 2)
    d = df.withColumn("margin", margin)
    p1 = norm_cdf(-(F.col(diff) + F.col("margin")) / F.col(se))
    p2 = norm_cdf((F.col(diff) - F.col("margin")) / F.col(se))
    d = d.withColumns({"p_lower": p1, "p_upper": p2})
    return d.withColumns({"tost_p": F.greatest("p_lower", "p_upper"), "tost_lo": F.col(diff) - z * F.col(se),
                          "tost_hi": F.col(diff) + z * F.col(se)}).withColumn("equivalent", F.col("tost_p") < 0.05)


def pooled_radius_curve(est: DataFrame, radii) -> DataFrame:
    """Wide beta_r / se_r columns to one inverse-variance pool per radius (three studies at least)."""
    arms = F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"beta_{r}").alias("beta"), F.col(f"se_{r}").alias("se")) for r in radii])
    long = est.select(F.explode(arms).alias("_a")).select("_a.*")
    return pool_fixed(long, ["r"]).where("k >= 3").select("r", F.col("pooled_pct").alias("pct"), "lo", "hi")


def hypothesis_report(h1: DataFrame, h2: DataFrame, h3: DataFrame, h4: DataFrame, h5: DataFrame, panel: DataFrame) -> DataFrame:
    """Verdict rows.  Inputs: h1 per-city differences (diff_beta, diff_lo, diff_hi, contains_zero), h2 bounds
    (slope_lo, slope_hi), h3 attenuation, h4 (mvt_rank, n_classes), h5 placebo and panel estimates (beta, se)."""
    row = lambda df, name, stat, value, verdict: df.select(
        F.lit(name).alias("hypothesis"), F.lit(stat).alias("statistic"), value.cast("double").alias("value"), verdict.alias("verdict"))
    d1 = h1.withColumn("se", (F.col("diff_hi") - F.col("diff_lo")) / (2 * 1.96)).withColumnRenamed("diff_beta", "beta")
    p1 = pool_fixed(d1, []).select("pooled_pct", "lo", "hi", F.lit(1).alias("_j"))
    n1 = h1.agg(F.count("*").alias("n"), F.count_if("contains_zero").alias("same"), F.lit(1).alias("_j"))
    j1 = n1.join(F.broadcast(p1), "_j")
    no1 = (F.col("same") >= F.col("n") / 2) & (F.col("lo") <= 0) & (F.col("hi") >= 0)
    yes = lambda cond, a, b: F.when(cond, a).otherwise(b)
    out = [row(j1, "H1", "pooled difference, percent", F.col("pooled_pct"), yes(no1, "falsified", "supported")),
           row(h2, "H2", "slope per kg, upper bound", F.col("slope_hi"),
               yes((F.col("slope_lo") <= 0) & (F.col("slope_hi") >= 0), "falsified", "supported"))]
    m3 = h3.agg(F.avg("attenuation").alias("m"), F.avg(F.when(F.col("attenuation") >= 0.40, 1.0).otherwise(0.0)).alias("s"))
    out.append(row(m3, "H3", "mean attenuation", F.col("m"), yes(F.col("s") > 0.5, "supported", "not supported")))
    m4 = h4.agg(F.count("*").alias("n"), F.count_if(F.col("mvt_rank") - 1 < F.col("n_classes") / 2).alias("u"))
    out.append(row(m4, "H4", "cities with MVT in the deterred half", F.col("u"), yes(F.col("u") > F.col("n") / 2, "more deterred", "less deterred")))
    p5, pp = pool_fixed(h5, []), pool_fixed(panel, [])
    out.append(row(p5, "H5", "pooled placebo, percent", F.col("pooled_pct"), yes((F.col("lo") <= 0) & (F.col("hi") >= 0), "clean", "fails")))
    out.append(row(pp, "pooled", "percent per SD", F.col("pooled_pct"), yes(F.col("substantively_negligible"), "negligible", "substantive")))
    return reduce(lambda a, b: a.unionByName(b), out)
