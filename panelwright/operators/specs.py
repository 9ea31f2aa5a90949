"""Specification grids over one panel, and the comparisons read off them.

Each grid is a list of specs fitted in one batched job per call.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.stats import pct_per_sd
from panelwright.functions.text import PROPERTY_CLASSES
from panelwright.operators.ppml import Spec, _full, coef_row, poisson_glm, ppml_fe, refuse_unreliable
from panelwright.operators.ranks import with_group
from panelwright.operators.sample import SES
from panelwright.session import cut

ATTENUATION_THRESHOLD = 0.40
MIN_SPLIT_EVENTS = 5000


def ladder_specs(x: str, controls=SES, outcomes=None, offset: str = "exposure") -> list[Spec]:
    """One model per crime class on the same terrain measure."""
    outcomes = outcomes or [f"n_{c}" for c in PROPERTY_CLASSES]
    return [Spec(y, y, [x, *controls], offset) for y in outcomes]


def radius_specs(y: str, measures: list[str], controls=SES, offset: str = "exposure") -> list[Spec]:
    return [Spec(m, y, [m, *controls], offset) for m in measures]


def enough_events(fit: DataFrame, least: int = 500) -> DataFrame:
    return fit.where(F.col("events") >= least)


def attenuation_path(df: DataFrame, keys: list[str], y: str, x: str, controls=SES,
                     offset: str = "exposure") -> DataFrame:
    """Terrain only, plus controls, plus absorbed groups: three effect rows per city.

    The sample is worked out once, not anew for each fit.
    """
    df = cut(df.select(*dict.fromkeys([*keys, "GEOID", y, x, *controls, offset])))
    cols = [*keys, "spec", "nobs", "beta", "se", "pct", "lo", "hi", "z"]
    out = None
    for label, xs, fe in (("1. terrain only", [x], False), ("2. + SES controls", [x, *controls], False),
                          ("3. + group effects", [x, *controls], True)):
        fit = (ppml_fe(df, [Spec("m", y, xs, offset)], keys) if fe
               else poisson_glm(df, y, xs, keys, offset))
        row = coef_row(fit).withColumn("spec", F.lit(label)).select(*cols)
        out = row if out is None else out.unionByName(row)
    return out


def mediation(df: DataFrame, keys: list[str], y: str, x: str, mediators: list[str],
              controls=SES, offset: str = "exposure") -> DataFrame:
    """How much of the coefficient survives the mediators (1 - |b1|/|b0|)."""
    fit = coef_row(ppml_fe(df, [Spec("before", y, [x, *controls], offset),
                                Spec("after", y, [x, *controls, *mediators], offset)], keys))
    w = fit.groupBy(*keys).pivot("model_id", ["before", "after"]).agg(
        F.first("beta").alias("beta"), F.first("se").alias("se"), F.first("pct").alias("pct"))
    att = F.when(F.abs("before_beta") > 1e-9, 1 - F.abs("after_beta") / F.abs("before_beta"))
    return w.withColumn("attenuation", att).withColumn("supports", att >= ATTENUATION_THRESHOLD)


def sample_rule(sample: str, cover: str = "park_cov") -> Column:
    return F.col(cover).between(0.5, 2.0) if sample == "measured" else F.lit(True)


def denominator_swap(df: DataFrame, keys: list[str], y: str, x: str, housing: str, target: str,
                     sample: str = "all", controls=SES, group: str = "GEOID") -> DataFrame:
    """The same outcome on the same rows under two offsets; unreliable fits are marked failed."""
    d = df.where(sample_rule(sample)) if sample == "measured" else df
    if sample == "floored":
        d = d.withColumn(target, F.greatest(F.col(target).cast("double"), F.lit(0.5)))
    d = d.where((F.col(housing) > 0) & (F.col(target) > 0))
    d = with_group(d, [*keys, group], _sz=F.count("*")).where("_sz >= 3").drop("_sz")
    sd = d.groupBy(*keys).agg(F.stddev_samp(x).alias("_sd"))
    xs = [x, *controls]
    fit = refuse_unreliable(coef_row(ppml_fe(
        d, [Spec("housing", y, xs, housing), Spec("target", y, xs, target)], keys, group)))
    fit = fit.join(sd, keys).withColumn("pct_per_sd", pct_per_sd(F.col("beta"), F.col("_sd"))).drop("_sd")
    b = lambda m: F.max(F.when(F.col("model_id") == m, F.abs("beta")))
    shrink = fit.groupBy(*keys).agg(b("housing").alias("_b0"), b("target").alias("_b1"))
    ratio = F.when(F.col("_b0") > 1e-9, 1 - F.col("_b1") / F.col("_b0"))
    return (fit.join(shrink, keys).withColumn("shrinkage_vs_housing", ratio)
               .withColumn("sample", F.lit(sample)).withColumnRenamed("model_id", "offset").drop("_b0", "_b1"))


def denominator_test(df: DataFrame, keys: list[str], targets: list[str], x: str, offset: str,
                     controls=SES, group: str = "GEOID") -> DataFrame:
    """Target counts regressed on terrain with the housing offset, positive targets only.

    The three-row group rule depends on which rows each target keeps, so it is
    counted per target first and enters each spec as a row filter.
    """
    counts = {f"_c_{t}": F.count_if(F.col(t) > 0) for t in targets}
    d = with_group(df, [*keys, group], **counts)
    specs = [Spec(t, t, [x, *controls], offset, where=(F.col(t) > 0) & (F.col(f"_c_{t}") >= 3)) for t in targets]
    return coef_row(ppml_fe(d, specs, keys, group))


def temporal_split(df: DataFrame, keys: list[str], x: str, pre: str, post: str, controls=SES,
                   offset: str = "exposure", least: int = MIN_SPLIT_EVENTS) -> DataFrame:
    """Before/after models; a side with too few events is reported as missing."""
    fit = coef_row(ppml_fe(df, [Spec("pre", pre, [x, *controls], offset),
                                Spec("post", post, [x, *controls], offset)], keys))
    ok = F.col("events") >= least
    return fit.select(*keys, F.col("model_id").alias("period"), "events",
                      *[F.when(ok, F.col(c)).alias(c) for c in ("beta", "se", "pct")])


def headline_repro_check(stored: DataFrame, fresh: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    j = stored.select(*keys, F.col("beta").alias("stored")).join(
        fresh.select(*keys, F.col("beta").alias("recomputed")), keys)
    gap = F.abs(F.col("stored") - F.col("recomputed"))
    return j.withColumn("abs_diff", gap).withColumn("ok", gap < tol)


def _identifying(df: DataFrame, y: str, x: list[str], keys: list[str], offset: str, group: str, least: int = 3) -> DataFrame:
    """(keys, grp, y, off, x0, ...): complete rows of groups with events and ``least`` rows or more."""
    num = lambda c: F.col(c).cast("double")
    ok = num(offset) > 0
    for c in [y, *x]:
        ok = ok & num(c).isNotNull()
    d = df.where(ok).select(*keys, F.col(group).cast("string").alias("grp"), num(y).alias("y"), F.log(num(offset)).alias("off"),
                            *[num(c).alias(f"x{j}") for j, c in enumerate(x)])
    return with_group(d, [*keys, "grp"], _sy=F.sum("y"), _sz=F.count("*")).where(f"_sy > 0 and _sz >= {least}").drop("_sy", "_sz")


def dummy_fit(d: DataFrame, keys: list[str], n_x: int, max_iter: int = 100, tol: float = 1e-10) -> DataFrame:
    """Group dummies and slopes fitted jointly: (keys, b, se, n, groups, iters, converged), clustered by group.

    The Newton system is block diagonal with a border: an intercept a group and the slopes.
    Intercepts are state of their own, a row a group; the slopes' step solves the Schur
    complement, summed over groups, and each intercept then follows from its own row.  No
    matrix holds the dummies, so any number of groups and keys is one job.
    """
    xs, p = [f"x{j}" for j in range(n_x)], n_x
    tri = [(j, k) for j in range(p) for k in range(j + 1)]
    mean = d.groupBy(*keys).agg(*[F.avg(v).alias(f"_m{v}") for v in xs])
    d = (d.join(mean, keys) if keys else d.join(F.broadcast(mean))).withColumns({v: F.col(v) - F.col(f"_m{v}") for v in xs}).drop(*[f"_m{v}" for v in xs])
    d = cut(d)
    kg = [*keys, "grp"]
    start = d.groupBy(*kg).agg((F.log(F.sum("y")) - F.log(F.sum(F.exp("off")))).alias("a")).withColumns({f"b{j}": F.lit(0.0) for j in range(p)})
    state = cut(start)

    def sums(state):
        eta = sum((F.col(f"b{j}") * F.col(v) for j, v in enumerate(xs)), F.col("a") + F.col("off"))
        m, r = F.exp(F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))), F.col("y") - F.col("_mu")
        g = d.join(state, kg).withColumn("_mu", m).groupBy(*kg).agg(
            F.first("a").alias("a"), *[F.first(f"b{j}").alias(f"b{j}") for j in range(p)], F.count("*").alias("n"), F.sum("_mu").alias("m"), F.sum(r).alias("r"),
            *[F.sum(F.col("_mu") * F.col(v)).alias(f"m{j}") for j, v in enumerate(xs)], *[F.sum(r * F.col(v)).alias(f"r{j}") for j, v in enumerate(xs)],
            *[F.sum(F.col("_mu") * F.col(xs[j]) * F.col(xs[k])).alias(f"h{j}_{k}") for j, k in tri])
        return cut(g)

    def schur(g):
        left = [F.col(f"r{j}") - F.col(f"m{j}") * F.col("r") / F.col("m") for j in range(p)]
        return g.groupBy(*keys).agg(
            F.array(*[F.sum(v) for v in left]).alias("score"), F.array(*[F.sum(F.col(f"h{j}_{k}") - F.col(f"m{j}") * F.col(f"m{k}") / F.col("m")) for j, k in tri]).alias("hess"),
            F.array(*[F.sum(left[j] * left[k]) for j, k in tri]).alias("meat"), F.max(F.abs("r")).alias("worst"), F.sum("n").alias("n"), F.count("*").alias("groups"),
            *[F.first(f"b{j}").alias(f"b{j}") for j in range(p)])

    types = dict(d.dtypes)
    ks = "".join(f"`{k}` {types[k]}, " for k in keys)

    def solve(batches):
        for pdf in batches:
            steps, move, se = [], [], []
            for score, hess, meat, n, groups in zip(pdf["score"], pdf["hess"], pdf["meat"], pdf["n"], pdf["groups"]):
                inv = np.linalg.pinv(_full(hess, p), hermitian=True)
                step = inv @ np.asarray(score, float)
                cov = inv @ _full(meat, p) @ inv * (groups / max(groups - 1, 1) * (n - 1) / max(n - groups - p, 1))
                steps.append(list(step))
                move.append(float(np.max(np.abs(step))))
                se.append(list(np.sqrt(np.maximum(np.diag(cov), 0))))
            pdf["step"], pdf["move"], pdf["se"] = steps, move, se
            pdf["b"] = [[float(pdf[f"b{j}"].iloc[i]) for j in range(p)] for i in range(len(pdf))]
            yield pdf[[*keys, "b", "se", "step", "move", "worst", "n", "groups"]]
    out = ks + "b array<double>, se array<double>, step array<double>, move double, worst double, n bigint, groups bigint"
    for it in range(1, max_iter + 1):
        g = sums(state)
        told = cut(schur(g).mapInPandas(solve, out))
        still = told.where(f"NOT (move < {tol} AND worst < 1e-8)").count()
        if not still or it == max_iter:
            return told.select(*keys, "b", "se", "n", "groups", F.lit(it).alias("iters"), F.expr(f"move < {tol} AND worst < 1e-8").alias("converged"))
        s = told.select(*keys, "step")
        j = g.join(s, keys) if keys else g.join(F.broadcast(s))
        step = [F.get("step", F.lit(q)) for q in range(p)]
        da = (F.col("r") - sum((F.col(f"m{q}") * step[q] for q in range(p)), F.lit(0.0))) / F.col("m")
        state = cut(j.select(*kg, (F.col("a") + da).alias("a"), *[(F.col(f"b{q}") + step[q]).alias(f"b{q}") for q in range(p)]))


def dummy_fe_check(df: DataFrame, y: str, x, keys: list[str] = (), offset: str = "exposure", group: str = "GEOID") -> DataFrame:
    """Effects of explicit group dummies against the absorbed fit, on the identifying sample, for every key at once.

    ``x``: the effect and its controls.  Compared are the first one's slope and error.
    """
    x, keys = [x] if isinstance(x, str) else list(x), list(keys)
    d = cut(_identifying(df, y, x, keys, offset, group))
    dummy = dummy_fit(d, keys, len(x)).select(*keys, F.get("b", F.lit(0)).alias("beta_dummy"), F.get("se", F.lit(0)).alias("se_dummy"), "converged")
    own = d.withColumnsRenamed({"y": "_y"}).withColumns({"exposure": F.exp("off"), "GEOID": F.col("grp")})
    fit = coef_row(ppml_fe(own, [Spec("m", "_y", [f"x{j}" for j in range(len(x))])], keys)).drop("converged")
    both = fit.join(dummy, keys) if keys else fit.join(F.broadcast(dummy))
    return both.select(*keys, "nobs", "n_groups", "beta", "beta_dummy", F.abs(F.col("beta") - F.col("beta_dummy")).alias("beta_diff"),
                       "se", "se_dummy", (F.col("se_dummy") / F.col("se")).alias("se_ratio"), "converged")
