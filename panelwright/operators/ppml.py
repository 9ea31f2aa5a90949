"""Poisson pseudo-ML with absorbed group effects, for many models in one job.

A *design* is one long frame ``(model, grp, y, off, w, x0..xp-1)``.  Given the
slopes, a group's effect has the closed form log(sum y / sum exp(xb+off)), so
the only state between steps is one small row per model.  Each Newton step is
one partial-aggregated ``groupBy(model, grp)`` and one ``groupBy(model)`` over
group rows; no step joins anything back to the data, and a group holding a
third of the rows is reduced on the map side before any shuffle.

The p-by-p solves run as Arrow batches over model rows on the executors; the
driver only learns how many models are still moving.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.stats import coef_columns
from panelwright.operators.ranks import with_group
from panelwright.session import cut

RIDGE = 1e-10
TOL = 1e-9
SCORE_FLOOR = 1e-13
MAX_ITER = 200
ETA_CAP = 30.0
# the per-model state (a key and p doubles per row) is broadcast only up to this many models
BROADCAST_MODELS = 50_000


class Spec:
    """One model: its name, outcome, regressors, offset column and row filter."""

    def __init__(self, model_id: str, y: str, x: list[str], offset: str = "exposure",
                 where: Column | None = None, fe: bool = True):
        self.model_id, self.y, self.x, self.offset, self.where, self.fe = (
            model_id, y, list(x), offset, where, fe)


def build_design(df: DataFrame, specs: list[Spec], keys: list[str], group: str = "GEOID",
                 carry: list[str] = ()) -> DataFrame:
    """Rows x specs, long: every spec of every key (city) is one model of one job.

    The rows are scanned once; an array of per-spec structs is exploded, with
    shorter specs padded by zero columns (the ridge pins those slopes at zero).
    """
    p = max(len(s.x) for s in specs)
    num = lambda c: F.col(c).cast("double")
    items = []
    for s in specs:
        ok = num(s.offset) > 0
        for c in [s.y, *s.x]:
            ok = ok & num(c).isNotNull()
        if s.where is not None:
            ok = ok & s.where
        fields = [F.lit(s.model_id).alias("model_id"),
                  (F.col(group).cast("string") if s.fe else F.lit("all")).alias("grp"),
                  F.col(group).cast("string").alias("clu"),
                  num(s.y).alias("y"), F.log(num(s.offset)).alias("off")]
        fields += [(num(s.x[j]) if j < len(s.x) else F.lit(0.0)).alias(f"x{j}") for j in range(p)]
        items.append(F.when(ok, F.struct(*fields)))
    long = df.select(*keys, *carry, F.explode(F.array_compact(F.array(*items))).alias("_d")).select(
        *keys, *carry, "_d.*")
    return long.withColumn("w", F.lit(1.0)).withColumn("p", F.lit(p))


def _xs(d: DataFrame) -> list[str]:
    n = len([c for c in d.columns if c[0] == "x" and c[1:].isdigit()])
    return [f"x{j}" for j in range(n)]


def centre_within(d: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract plain group means: slopes are unchanged, cross-products lose no digits."""
    xs = _xs(d)
    out = with_group(d, [*keys, "grp"], **{f"_m{x}": F.avg(x) for x in xs})
    # a group-constant regressor must be exactly zero, not rounding noise the ridge would amplify
    for x in xs:
        dev, m = F.col(x) - F.col(f"_m{x}"), F.col(f"_m{x}")
        noise = F.abs(dev) <= 1e-12 * F.greatest(F.abs(m), F.lit(1.0))
        out = out.withColumn(x, F.when(noise, 0.0).otherwise(dev))
    return out.drop(*[f"_m{x}" for x in xs])


def _linear(xs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"_b{j}") * F.col(x) for j, x in enumerate(xs)])


def _base(xs: list[str]) -> Column:
    eta = _linear(xs) + F.col("off")
    return F.exp(F.least(F.greatest(eta, F.lit(-ETA_CAP)), F.lit(ETA_CAP)))


def join_state(d: DataFrame, state: DataFrame, keys: list[str], n_models: int | None) -> DataFrame:
    """Attach slopes to rows as plain columns _b0.. (an array in an aggregation buffer would turn
    hash into sort aggregation); small states (by count) are broadcast, others join by shuffle."""
    s = state.select(*keys, *[F.get("b", F.lit(j)).alias(f"_b{j}") for j in range(len(_xs(d)))])
    return d.join(F.broadcast(s) if n_models is not None and n_models <= BROADCAST_MODELS else s, keys)


class Moments:
    """The sums of one Newton step as reusable Column lists (they do not depend on the state)."""

    def __init__(self, xs: list[str]):
        self.xs, p = xs, len(xs)
        e, col = F.col("w") * F.col("_e"), F.col
        self.base = _base(xs)
        slopes = [f"_b{j}" for j in range(p)]
        self.group = [*[F.first(b).alias(b) for b in slopes], F.sum("w").alias("gn"),
                      F.sum(col("w") * col("y")).alias("sy"), F.sum(e).alias("se")]
        for j, x in enumerate(xs):
            self.group += [F.sum(col("w") * col("y") * col(x)).alias(f"syx{j}"),
                           F.sum(e * col(x)).alias(f"sex{j}")]
            self.group += [F.sum(e * col(x) * col(xs[k])).alias(f"sxx{j}_{k}") for k in range(j + 1)]
        ratio = F.when(col("se") > 0, col("sy") / col("se")).otherwise(0.0)
        s = [col(f"syx{j}") - ratio * col(f"sex{j}") for j in range(p)]
        tri = [(j, k) for j in range(p) for k in range(j + 1)]
        cross = lambda j, k: col(f"sex{j}") * col(f"sex{k}") / col("se")
        self.step = [F.array(*[F.first(b) for b in slopes]).alias("b"), F.array(*[F.sum(v) for v in s]).alias("score"),
                     F.array(*[F.sum(ratio * (col(f"sxx{j}_{k}") - cross(j, k))) for j, k in tri]).alias("hess"),
                     F.sum("sy").alias("events")]
        self.report = [F.sum("gn").alias("nobs"), F.count("*").alias("n_groups"),
                       F.count_if(col("gn") == 1).alias("n_singleton_groups"),
                       F.count_if(col("sy") == 0).alias("n_allzero_groups"),
                       F.array(*[F.sum(s[j] * s[k]) for j, k in tri]).alias("meat")]

    def groups(self, d: DataFrame, state: DataFrame, keys: list[str], n_models: int | None) -> DataFrame:
        """Per (model, group) sums at the current slopes, partially aggregated before the shuffle."""
        return (join_state(d, state, keys, n_models).withColumn("_e", self.base)
                .groupBy(*keys, "grp").agg(*self.group))


def _full(flat, p: int) -> np.ndarray:
    a = np.zeros((p, p))
    a[np.tril_indices(p)] = flat
    return a + np.tril(a, -1).T


def _newton(batches):
    for pdf in batches:
        out = []
        for b, score, hess, events in zip(pdf["b"], pdf["score"], pdf["hess"], pdf["events"]):
            b, score = np.asarray(b, float), np.asarray(score, float)
            h = _full(hess, len(b)) + RIDGE * np.eye(len(b))
            try:
                step = np.linalg.solve(h, score)
            except np.linalg.LinAlgError:
                step = np.full(len(b), np.nan)
            # the first-order condition is the one to trust: at the rounding floor of the
            # score a nearly collinear fit keeps stepping by noise
            flat = np.max(np.abs(score)) <= SCORE_FLOOR * max(events, 1.0)
            size = 0.0 if flat else float(np.max(np.abs(step)))
            out.append((list(b + step), size))
        pdf = pdf.drop(columns=["score", "hess", "events"])
        pdf["b"] = [o[0] for o in out]
        pdf["step"] = [o[1] for o in out]
        yield pdf


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def newton_slopes(d: DataFrame, keys: list[str], max_iter: int = MAX_ITER,
                  tol: float = TOL) -> DataFrame:
    """Slopes of every model: (keys, b array, iters, converged).

    Converged models leave the active set, so late rounds touch only the rows
    of models that still move.  State is checkpointed between rounds.
    """
    sums = Moments(_xs(d))
    zero = F.array_repeat(F.lit(0.0), len(sums.xs))
    active = cut(d.select(*keys).distinct().withColumn("b", zero))
    moving = active.count()
    done = []
    out_schema = f"{_schema(d, keys)}, b array<double>, step double"
    for it in range(1, max_iter + 1):
        solved = (sums.groups(d, active, keys, moving).groupBy(*keys).agg(*sums.step)
                      .mapInPandas(_newton, out_schema))
        moved = cut(solved.withColumn("iters", F.lit(it)))
        fixed = (F.col("step") < tol) | F.isnan("step")
        left = moved.agg(F.count_if(~fixed), F.count_if(fixed)).first()
        if left[1] or it == max_iter:
            last = moved if it == max_iter else moved.where(fixed)
            done.append(last.withColumn("converged", F.col("step") < tol).drop("step"))
        if left[0] == 0 or it == max_iter:
            break
        active, moving = moved.where(~fixed), left[0]
    return reduce(lambda a, b: a.unionByName(b), done)


def _sandwich(batches):
    for pdf in batches:
        bse, naive, cov = [], [], []
        for hess, meat, g in zip(pdf["hess"], pdf["meat"], pdf["n_groups"]):
            h = np.asarray(hess, float)
            p = int((np.sqrt(8 * len(h) + 1) - 1) / 2)
            full = _full(h, p)
            bread = np.linalg.inv(full + RIDGE * np.eye(p))
            v = bread @ _full(np.asarray(meat, float), p) @ bread * (g / max(g - 1, 1))
            bse.append(list(np.sqrt(np.maximum(np.diag(v), 0))))
            naive.append(list(np.sqrt(np.maximum(np.diag(bread), 0))))
            cov.append(list(v.ravel()))
        pdf["bse"], pdf["naive"], pdf["cov"] = bse, naive, cov
        yield pdf.drop(columns=["hess", "meat"])


def cluster_sandwich(d: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Clustered and naive standard errors plus identification diagnostics at given slopes."""
    sums = Moments(_xs(d))
    m = sums.groups(d, state, keys, state.count()).groupBy(*keys).agg(*sums.step, *sums.report)
    top = F.array_max(F.transform("score", F.abs))
    m = m.withColumn("max_abs_score", top)
    schema = (f"{_schema(d, keys)}, nobs double, events double, n_groups bigint, "
              "n_singleton_groups bigint, n_allzero_groups bigint, max_abs_score double, "
              "bse array<double>, naive array<double>, cov array<double>")
    cols = [*keys, "hess", "nobs", "events", "n_groups", "n_singleton_groups", "n_allzero_groups",
            "meat", "max_abs_score"]
    return m.select(*cols).mapInPandas(_sandwich, schema)


def fitted_mu(d: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the fitted mean ``mu`` and Pearson residual, from the slopes alone."""
    xs = _xs(d)
    e = join_state(d, state, keys, state.count()).withColumn("_e", _base(xs)).drop(*[f"_b{j}" for j in range(len(xs))])
    e = with_group(e, [*keys, "grp"], _sy=F.sum(F.col("w") * F.col("y")),
                   _se=F.sum(F.col("w") * F.col("_e")))
    mu = F.col("_e") * F.greatest("_sy", F.lit(1e-12)) / F.greatest("_se", F.lit(1e-12))
    out = e.withColumn("mu", mu).drop("_e", "_sy", "_se")
    return out.withColumn("resid", (F.col("y") - F.col("mu")) / F.sqrt(F.greatest("mu", F.lit(1e-9))))


def ppml_fe(df: DataFrame, specs: list[Spec], keys: list[str], group: str = "GEOID",
            max_iter: int = MAX_ITER) -> DataFrame:
    """Fit every (key, spec) model at once; one result row per model with arrays b and bse."""
    keys_m = [*keys, "model_id"]
    d = centre_within(build_design(df, specs, keys, group), keys_m).persist()
    try:
        state = newton_slopes(d, keys_m, max_iter)
        se = cluster_sandwich(d, state, keys_m)
        sep = (fitted_mu(d, state, keys_m).groupBy(*keys_m)
               .agg(F.count_if((F.col("y") == 0) & (F.col("mu") < 1e-10)).alias("n_separated")))
        return cut(state.join(se, keys_m).join(sep, keys_m))
    finally:
        d.unpersist()


def coef_row(fit: DataFrame, at: int = 0) -> DataFrame:
    """The named effect row (beta, se, irr, percent, interval, z) of one regressor."""
    out = fit.withColumn("beta", F.get("b", F.lit(at))).withColumn("se", F.get("bse", F.lit(at)))
    return out.withColumns(coef_columns(F.col("beta"), F.col("se")))


def refuse_unreliable(fit: DataFrame) -> DataFrame:
    """Mark fits that must be reported as failed: judged on the score, not the step."""
    rel = F.col("max_abs_score") / F.greatest("events", F.lit(1.0))
    se = F.get("bse", F.lit(0))
    return fit.withColumn("rel_score", rel).withColumn(
        "failed", (rel > 1e-8) | se.isNull() | F.isnan(se) | (se < 1e-6))


def poisson_glm(df: DataFrame, y: str, x: list[str], keys: list[str], offset: str = "exposure",
                group: str = "GEOID") -> DataFrame:
    """Poisson without fixed effects, clustered on ``group``.

    The intercept is absorbed as the effect of one all-rows group; scores of
    the intercept enter the sandwich through the residuals' cluster sums.
    """
    keys_m = [*keys, "model_id"]
    d = build_design(df, [Spec("glm", y, x, offset, fe=False)], keys, group)
    d = centre_within(d, keys_m).persist()
    try:
        p = len(x)
        state = newton_slopes(d, keys_m)
        mu = fitted_mu(d, state, keys_m)
        ones = [F.lit(1.0)] + [F.col(c) for c in _xs(d)]
        clu = mu.groupBy(*keys_m, "clu").agg(
            *[F.sum((F.col("y") - F.col("mu")) * v).alias(f"s{j}") for j, v in enumerate(ones)],
            *[F.sum(F.col("mu") * ones[j] * ones[k]).alias(f"h{j}_{k}")
              for j in range(p + 1) for k in range(j + 1)],
            F.sum("w").alias("gn"), F.sum("y").alias("gy"))
        tri = [(j, k) for j in range(p + 1) for k in range(j + 1)]
        m = clu.groupBy(*keys_m).agg(
            F.array(*[F.sum(f"h{j}_{k}") for j, k in tri]).alias("hess"),
            F.sum("gn").alias("nobs"), F.sum("gy").alias("events"), F.count("*").alias("n_groups"),
            F.lit(0).cast("bigint").alias("n_singleton_groups"),
            F.lit(0).cast("bigint").alias("n_allzero_groups"),
            F.array(*[F.sum(F.col(f"s{j}") * F.col(f"s{k}")) for j, k in tri]).alias("meat"),
            F.array_max(F.array(*[F.abs(F.sum(f"s{j}")) for j in range(p + 1)])).alias("max_abs_score"))
        schema = (f"{_schema(d, keys_m)}, nobs double, events double, n_groups bigint, "
                  "n_singleton_groups bigint, n_allzero_groups bigint, max_abs_score double, "
                  "bse array<double>, naive array<double>, cov array<double>")
        se = m.select(*keys_m, "hess", "nobs", "events", "n_groups", "n_singleton_groups",
                      "n_allzero_groups", "meat", "max_abs_score").mapInPandas(_sandwich, schema)
        # slot 0 is the intercept; drop it so b and bse line up, and apply the row-count
        # correction (n-1)/(n-k) the unabsorbed estimator carries
        small = F.sqrt((F.col("nobs") - 1) / (F.col("nobs") - p - 1))
        se = se.withColumn("bse", F.transform(F.slice("bse", 2, p), lambda v: v * small))
        se = se.withColumn("naive", F.slice("naive", 2, p))
        return cut(state.join(se, keys_m))
    finally:
        d.unpersist()
