"""Queries: pooling of study estimates (one study per nation, one pool per region)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelwright.functions.stats import norm_ppf
from panelwright.operators import meta, ppml, resample, sample, specs
from panelwright.operators.ppml import Spec
from panelwright.plans import inputs as I
from panelwright.plans.inputs import STU_SQL, q6, r6
from panelwright.plans.queries_clean import erf_sql
from panelwright.plans.registry import query

FIX_SQL = f"""{STU_SQL}, fw AS (SELECT *, 1 / (se * se) AS w FROM stu), fm AS (SELECT pool, count(*) AS nk, sum(w * beta) / sum(w) AS mu, sqrt(1 / sum(w)) AS s, sum(w) AS sw, sum(w * w) AS sw2 FROM fw GROUP BY 1),
  fq AS (SELECT pool, any_value(nk) AS k, any_value(mu) AS mu, any_value(s) AS s, any_value(sw) AS sw, any_value(sw2) AS sw2, sum(w * (beta - mu) ** 2) AS q FROM fw JOIN fm USING (pool) GROUP BY 1)"""


@query("pool_fixed", f"""WITH {FIX_SQL} SELECT pool, k, {q6('mu', 8)} AS mu, {q6('s', 8)} AS se, {q6('q', 5)} AS "Q", {q6('CASE WHEN q > 0 THEN greatest((q - greatest(k - 1, 1)) / q, 0) ELSE 0 END')} AS "I2",
   {q6('100 * (exp(mu) - 1)')} AS pooled_pct, {q6('100 * (exp(mu - 1.96 * s) - 1)')} AS lo, {q6('100 * (exp(mu + 1.96 * s) - 1)')} AS hi, abs(100 * (exp(mu) - 1)) < 5 AS substantively_negligible FROM fq""")
def _(t):
    p = meta.pool_fixed(I.studies(t), ["pool"])
    return p.select("pool", "k", r6("mu", 8).alias("mu"), r6("se", 8).alias("se"), r6("Q", 5).alias("Q"), *[r6(c).alias(c) for c in ("I2", "pooled_pct", "lo", "hi")], "substantively_negligible")


@query("tau2_dl", f"""WITH {FIX_SQL} SELECT pool, {q6('greatest(0, (q - (k - 1)) / (sw - sw2 / sw))', 9)} AS tau2_dl FROM fq""")
def _(t):
    return meta.tau2_all(I.studies(t), ["pool"]).select("pool", r6("tau2_dl", 9).alias("tau2_dl"))


REML_SQL = FIX_SQL + ", t0 AS (SELECT pool, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS t FROM fq)" + "".join(
    f""", m{i} AS MATERIALIZED (SELECT pool, any_value(t) AS t, sum(beta / (se * se + t)) / sum(1 / (se * se + t)) AS mu, sum(1 / (se * se + t)) AS a FROM stu JOIN t{i} USING (pool) GROUP BY 1),
    t{i + 1} AS MATERIALIZED (SELECT pool, greatest(0, sum(((beta - mu) ** 2 - se * se) / (se * se + t) ** 2) / sum(1 / (se * se + t) ** 2) + 1 / any_value(a)) AS t FROM stu JOIN m{i} USING (pool) GROUP BY 1)"""
    for i in range(60))


@query("tau2_reml", f"WITH {REML_SQL} SELECT pool, {q6('t', 9)} AS tau2 FROM t60")
def _(t):
    return meta.tau2_all(I.studies(t), ["pool"]).select("pool", r6("tau2", 9).alias("tau2"))


def _root(f, target, lo, hi, steps=200):
    """Where the growing function ``f`` meets ``target``."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def _chi2_upto(x: float, df: int) -> float:
    """Chi-squared distribution function by its series."""
    a, h, term = df / 2, x / 2, 1.0
    total = term
    for n in range(1, 500):
        term *= h / (a + n)
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if x > 0 else 0.0


def _t_upto(x: float, df: int, n: int = 2000) -> float:
    """Student's distribution function, the density integrated by Simpson's rule over the angle."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    top = math.atan(x / math.sqrt(df))
    f = lambda a: math.cos(a) ** (df - 1)
    h = top / n
    return 0.5 + c * h / 3 * (f(0) + f(top) + 4 * sum(f(h * k) for k in range(1, n, 2)) + 2 * sum(f(h * k) for k in range(2, n, 2)))


def _of_free(name: str, values: dict) -> str:
    """SQL of a number that depends on degrees of freedom."""
    return f"CASE {name} " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in values.items()) + " END"


FREE = range(1, 26)             # a pool has 25 studies at most, one a nation
CHI_LO, CHI_HI = ({k: _root(lambda x: _chi2_upto(x, k), q, 0.0, 200.0) for k in FREE} for q in (0.975, 0.025))
T_975 = {k: _root(lambda x: _t_upto(x, k), 0.975, 0.0, 60.0, 60) for k in FREE}


def _q_root_sql(name: str, source: str, target: str) -> str:
    """``name``(pool, t): the variance at which Q of the pool falls to ``target`` (a column of ``source``), 0 if it starts below, by bisection."""
    q = "sum((beta - m0) ** 2 / (se * se + {t})) - sum((beta - m0) / (se * se + {t})) ** 2 / sum(1 / (se * se + {t}))"
    return f"""{name}_a AS (SELECT pool, any_value({target}) AS target, {q.format(t='0')} AS q0 FROM {source} GROUP BY 1),
  {name}_b AS (SELECT pool, target, 0.0::DOUBLE AS lo, 4.0::DOUBLE AS hi, 0 AS it FROM {name}_a WHERE q0 > target UNION ALL
    SELECT pool, target, CASE WHEN q > target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN q > target THEN hi ELSE (lo + hi) / 2 END, it + 1
    FROM (SELECT b.pool, b.target, lo, hi, it, {q.format(t='(lo + hi) / 2')} AS q FROM {name}_b b JOIN {source} s ON s.pool = b.pool WHERE it < 90 GROUP BY 1, 2, 3, 4, 5)),
  {name} AS (SELECT a.pool, coalesce((lo + hi) / 2, 0) AS t FROM {name}_a a LEFT JOIN {name}_b b ON b.pool = a.pool AND it = 90 WHERE a.target IS NOT NULL)"""


def _random_sql(source: str) -> str:
    """CTEs from ``source`` (pool, beta, se) to ``rnd``: REML by fixed-point steps, errors, intervals, heterogeneity."""
    fixed = "".join(f""", m{i} AS MATERIALIZED (SELECT pool, any_value(t) AS t, sum(beta / (se * se + t)) / sum(1 / (se * se + t)) AS mu, sum(1 / (se * se + t)) AS a FROM sx JOIN t{i} USING (pool) GROUP BY 1),
    t{i + 1} AS MATERIALIZED (SELECT pool, CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, sum(((beta - mu) ** 2 - se * se) / (se * se + t) ** 2) / sum(1 / (se * se + t) ** 2) + 1 / any_value(a)) END AS t FROM sx JOIN m{i} USING (pool) GROUP BY 1)"""
                    for i in range(60))
    return f"""sx AS MATERIALIZED (SELECT *, avg(beta) OVER (PARTITION BY pool) AS m0, count(*) OVER (PARTITION BY pool) AS kk FROM {source}),
  pf AS (SELECT pool, count(*) AS k, sum(1 / (se * se)) AS sa, sum(1 / se ** 4) AS sa2, sum((beta - m0) ** 2 / (se * se)) - sum((beta - m0) / (se * se)) ** 2 / sum(1 / (se * se)) AS q FROM sx GROUP BY 1),
  t0 AS (SELECT pool, CASE WHEN k < 2 THEN 0 ELSE greatest(0, (q - (k - 1)) / (sa - sa2 / sa)) END AS t FROM pf){fixed},
  rs AS (SELECT pool, any_value(t) AS tau2, any_value(m0) + sum((beta - m0) / (se * se + t)) / sum(1 / (se * se + t)) AS mu, sqrt(1 / sum(1 / (se * se + t))) AS se,
    sum((beta - m0) ** 2 / (se * se + t)) - sum((beta - m0) / (se * se + t)) ** 2 / sum(1 / (se * se + t)) AS qs FROM sx JOIN t60 USING (pool) GROUP BY 1),
  rh AS (SELECT rs.*, pf.k, q, (k - 1) * sa / CASE WHEN k > 1 THEN sa * sa - sa2 END AS typical, CASE WHEN k = 1 THEN rs.se ELSE rs.se * sqrt(greatest(qs / (k - 1), 1e-12)) END AS se_hk FROM rs JOIN pf USING (pool)),
  rnd AS (SELECT *, CASE WHEN k = 1 THEN {norm_ppf(0.975)!r} * se ELSE ({_of_free('k - 1', T_975)}) * se_hk END AS half, CASE WHEN k >= 3 THEN ({_of_free('k - 2', T_975)}) * sqrt(tau2 + se * se) END AS pred,
    CASE WHEN k = 1 OR tau2 + typical <= 0 THEN 0 ELSE tau2 / (tau2 + typical) END AS i2 FROM rh)"""


@query("tau2_pm", f"WITH RECURSIVE {STU_SQL}, sx AS (SELECT *, avg(beta) OVER (PARTITION BY pool) AS m0, (count(*) OVER (PARTITION BY pool) - 1)::DOUBLE AS free FROM stu), {_q_root_sql('pm', 'sx', 'free')} SELECT pool, {q6('t', 8)} AS tau2_pm FROM pm")
def _(t):
    return meta.tau2_all(I.studies(t), ["pool"]).select("pool", r6("tau2_pm", 8).alias("tau2_pm"))


@query("tau2_qprofile", f"""WITH RECURSIVE {STU_SQL}, sk AS (SELECT *, avg(beta) OVER (PARTITION BY pool) AS m0, count(*) OVER (PARTITION BY pool) AS kk FROM stu),
  sx AS (SELECT *, CASE WHEN kk >= 3 THEN {_of_free('kk - 1', CHI_LO)} END AS c_lo, CASE WHEN kk >= 3 THEN {_of_free('kk - 1', CHI_HI)} END AS c_hi FROM sk),
  {_q_root_sql('a', 'sx', 'c_lo')}, {_q_root_sql('z', 'sx', 'c_hi')}
  SELECT k.pool, {q6('coalesce(a.t, 0)', 8)} AS tau2_lo, {q6('z.t', 8)} AS tau2_hi FROM (SELECT DISTINCT pool FROM sx) k LEFT JOIN a ON a.pool = k.pool LEFT JOIN z ON z.pool = k.pool""")
def _(t):
    return meta.tau2_all(I.studies(t), ["pool"]).select("pool", r6("tau2_lo", 8).alias("tau2_lo"), r6("tau2_hi", 8).alias("tau2_hi"))


@query("pool_random", f"""WITH {STU_SQL}, {_random_sql('stu')} SELECT pool, k, {q6('mu', 7)} AS mu, {q6('se', 7)} AS se, {q6('se_hk', 7)} AS se_hk, {q6('mu - half')} AS lo, {q6('mu + half')} AS hi, {q6('tau2', 8)} AS tau2, {q6('sqrt(tau2)', 5)} AS tau,
  {q6('i2')} AS "I2", {q6('greatest(q, 0)', 5)} AS "Q", {q6('mu - pred')} AS pi_lo, {q6('mu + pred')} AS pi_hi, {q6('100 * (exp(mu) - 1)', 5)} AS pct, {q6('100 * (exp(mu - half) - 1)', 4)} AS pct_lo, {q6('100 * (exp(mu + half) - 1)', 4)} AS pct_hi,
  CASE WHEN k = 1 THEN 'single' ELSE 'REML + Hartung-Knapp' END AS method FROM rnd""")
def _(t):
    p = meta.pool_random(I.studies(t), ["pool"])
    digits = {"mu": 7, "se": 7, "se_hk": 7, "lo": 6, "hi": 6, "tau2": 8, "tau": 5, "I2": 6, "Q": 5, "pi_lo": 6, "pi_hi": 6, "pct": 5, "pct_lo": 4, "pct_hi": 4}
    return p.select("pool", "k", *[r6(c, n).alias(c) for c, n in digits.items()], "method")


@query("leave_one_out", f"""WITH {STU_SQL}, loo AS (SELECT a.pool || '|' || b.study AS pool, a.beta, a.se FROM stu a JOIN stu b ON b.pool = a.pool AND b.study <> a.study), {_random_sql('loo')}
  SELECT split_part(pool, '|', 1)::INT AS pool, split_part(pool, '|', 2) AS dropped, k, {q6('100 * (exp(mu) - 1)', 5)} AS pct, {q6('100 * (exp(mu - half) - 1)', 4)} AS lo, {q6('100 * (exp(mu + half) - 1)', 4)} AS hi, {q6('tau2', 8)} AS tau2, {q6('i2')} AS "I2" FROM rnd""")
def _(t):
    d = meta.leave_one_out(I.studies(t), ["pool"], "study")
    digits = {"pct": 5, "lo": 4, "hi": 4, "tau2": 8, "I2": 6}
    return d.select("pool", "dropped", "k", *[r6(c, n).alias(c) for c, n in digits.items()])


def _line_sql(name: str, source: str, t2: str) -> str:
    """Weighted line through (xmod, beta): its sums, coefficients and residual Q, about the mean of beta."""
    return f"""{name}w AS (SELECT s.*, 1 / (se * se + {t2}) AS w FROM {source}), {name}s AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * xmod) AS sx, sum(w * xmod * xmod) AS sxx, sum(w * (beta - m0)) AS sy,
    sum(w * xmod * (beta - m0)) AS sxy, sum(w * (beta - m0) ** 2) AS syy, sum(w * w) AS w2, sum(w * w * xmod) AS w2x, sum(w * w * xmod * xmod) AS w2xx, any_value(m0) AS m0 FROM {name}w),
  {name}d AS (SELECT *, sw * sxx - sx * sx AS det FROM {name}s), {name} AS (SELECT *, (sxx * sy - sx * sxy) / det AS b0, (sw * sxy - sx * sy) / det AS b1,
    greatest(syy - (sxx * sy - sx * sxy) / det * sy - (sw * sxy - sx * sy) / det * sxy, 0) AS qe, sw - (sxx * w2 - 2 * sx * w2x + sw * w2xx) / det AS tr FROM {name}d)"""


REG_SQL = f"""{STU_SQL}, sc AS (SELECT *, avg(beta) OVER () AS m0 FROM stu), {_line_sql('r1', 'sc s', '0')}, tv AS (SELECT CASE WHEN k > 2 AND tr > 0 THEN greatest(0, (qe - (k - 2)) / tr) ELSE 0 END AS t2 FROM r1),
  {_line_sql('r2', 'sc s, tv', 't2')}, rg AS (SELECT r2.*, t2, greatest(qe / (k - 2), 1e-12) AS scale FROM r2, tv),
  tm AS (SELECT 'intercept' AS term, b0 + m0 AS beta, sqrt(sxx / det * scale) AS se, k, t2, qe FROM rg UNION ALL SELECT 'xmod', b1, sqrt(sw / det * scale), k, t2, qe FROM rg)"""


@query("meta_regression", f"""WITH {REG_SQL}, one AS (SELECT 1 AS pool, beta, se FROM stu), {_random_sql('one')}
  SELECT term, {q6('tm.beta', 7)} AS beta, {q6('tm.se', 7)} AS se, tm.k, {q6('t2', 8)} AS tau2_resid, {q6('tau2', 8)} AS tau2_null, {q6('CASE WHEN tau2 > 0 THEN greatest(1 - t2 / tau2, 0) END', 5)} AS "R2", {q6('qe', 5)} AS "Qe",
  {q6('tm.beta / tm.se', 5)} AS t, {q6(f"tm.beta - ({_of_free('tm.k - 2', T_975)}) * tm.se")} AS lo, {q6(f"tm.beta + ({_of_free('tm.k - 2', T_975)}) * tm.se")} AS hi FROM tm, rnd""")
def _(t):
    d = meta.meta_regression(I.studies(t), [], ["xmod"])
    digits = {"beta": 7, "se": 7, "tau2_resid": 8, "tau2_null": 8, "R2": 5, "Qe": 5, "t": 5, "lo": 6, "hi": 6}
    return d.select("term", "k", *[r6(c, n).alias(c) for c, n in digits.items()])


@query("meta_prediction_grid", f"""WITH {REG_SQL}, b AS (SELECT max(beta) FILTER (term = 'intercept') AS b0, max(beta) FILTER (term = 'xmod') AS b1 FROM tm), x AS (SELECT min(xmod) AS lo, max(xmod) AS hi FROM stu),
  g AS (SELECT i::INT AS i, lo + (hi - lo) * i / 59 AS xmod FROM x, range(60) r(i)) SELECT i, {q6('xmod')} AS xmod, {q6('100 * (exp(b0 + b1 * xmod) - 1)', 5)} AS pct FROM g, b""")
def _(t):
    s = I.studies(t)
    d = meta.prediction_grid(meta.meta_regression(s, [], ["xmod"]), s, "xmod")
    return d.select("i", r6("xmod").alias("xmod"), r6("pct", 5).alias("pct"))


WLS_SQL = f"""{STU_SQL}, w AS (SELECT *, 1 / (se * se) AS w FROM stu), m AS (SELECT sum(w * xmod) / sum(w) AS mx, sum(w * beta) / sum(w) AS my FROM w),
  c AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * (xmod - mx) ** 2) AS xx, sum(w * (xmod - mx) * (beta - my)) AS xy, sum(w * (beta - my) ** 2) AS yy, any_value(mx) AS mx, any_value(my) AS my FROM w, m),
  l AS (SELECT *, xy / xx AS b, my - xy / xx * mx AS a, (yy - xy * xy / xx) / greatest(n - 2, 1) AS s2 FROM c)"""


@query("wls_two_stage", f"""WITH {WLS_SQL} SELECT n, {q6('a', 8)} AS intercept, {q6('b', 8)} AS slope, {q6('sqrt(s2 * (1 / sw + mx * mx / xx))', 7)} AS intercept_se, {q6('sqrt(s2 / xx)', 7)} AS slope_se,
   {q6('100 * (exp(my) - 1)')} AS naive_mean_pct FROM l""")
def _(t):
    w = meta.wls_line(I.studies(t), [], "xmod")
    return w.select("n", r6("intercept", 8).alias("intercept"), r6("slope", 8).alias("slope"), r6("intercept_se", 7).alias("intercept_se"),
                    r6("slope_se", 7).alias("slope_se"), r6("naive_mean_pct").alias("naive_mean_pct"))


@query("trend_wls", f"""WITH {WLS_SQL.replace('xmod', 'kg').replace('FROM stu)', "FROM (SELECT * EXCLUDE (kg), (ARRAY[0.3, 2, 7, 14, 25])[k % 5 + 1]::DOUBLE AS kg FROM stu))")} SELECT {q6('b', 8)} AS slope_per_kg,
   {q6('100 * (exp(a) - 1)')} AS intercept_at_0kg_pct, {q6('100 * (exp(a + 25 * b) - 1)')} AS pred_at_25kg_pct FROM l""")
def _(t):
    kg = F.element_at(F.array(*[F.lit(v) for v in (0.3, 2.0, 7.0, 14.0, 25.0)]), F.col("k") % 5 + 1)
    w = meta.wls_line(I.studies(t).withColumn("kg", kg), [], "kg")
    return w.select(r6("slope", 8).alias("slope_per_kg"), r6("intercept_pct").alias("intercept_at_0kg_pct"),
                    r6(100 * (F.exp(F.col("intercept") + 25 * F.col("slope")) - 1)).alias("pred_at_25kg_pct"))


@query("tost", f"""WITH {STU_SQL}, p AS (SELECT study, {erf_sql('(-(beta + 0.03) / se)')} AS p1, {erf_sql('((beta - 0.03) / se)')} AS p2, beta, se FROM stu)
   SELECT study, {q6('greatest(p1, p2)')} AS tost_p, greatest(p1, p2) < 0.05 AS equivalent, {q6(f'beta - {norm_ppf(0.95)!r}::DOUBLE * se')} AS tost_lo FROM p""")
def _(t):
    d = meta.tost(I.studies(t), "beta", "se", F.lit(0.03))
    return d.select("study", r6("tost_p").alias("tost_p"), "equivalent", r6("tost_lo").alias("tost_lo"))


@query("pooled_radius_curve", f"""WITH {STU_SQL}, l AS (SELECT unnest([50, 100, 250]) AS r, unnest([beta, beta + 0.01, beta * 2]) AS b, unnest([se, se * 1.1, se * 2]) AS s FROM stu),
   g AS (SELECT r, sum(b / (s * s)) / sum(1 / (s * s)) AS mu, sqrt(1 / sum(1 / (s * s))) AS se FROM l GROUP BY 1)
   SELECT r, {q6('100 * (exp(mu) - 1)')} AS pct, {q6('100 * (exp(mu - 1.96 * se) - 1)')} AS lo, {q6('100 * (exp(mu + 1.96 * se) - 1)')} AS hi FROM g""")
def _(t):
    b, s = F.col("beta"), F.col("se")
    e = I.studies(t).select(b.alias("beta_50"), s.alias("se_50"), (b + 0.01).alias("beta_100"), (s * 1.1).alias("se_100"), (b * 2).alias("beta_250"), (s * 2).alias("se_250"))
    c = meta.pooled_radius_curve(e, [50, 100, 250])
    return c.select("r", *[r6(x).alias(x) for x in ("pct", "lo", "hi")])


@query("hypothesis_report")
def _(t):
    off = "housing_units_cell"
    d = I.panel(t).withColumn("n_theft", sample.theft_total(I.panel(t)))
    h1 = resample.cluster_bootstrap_diff(d, Spec("a", "n_theft", ["slope_deg"], off), Spec("b", "n_NO_LOOT", ["slope_deg"], off), ["city"], reps=600)
    ladder = ppml.coef_row(ppml.ppml_fe(d, specs.ladder_specs("slope_deg", [], offset=off), ["city"]))
    kg = F.element_at(F.create_map(*[F.lit(v) for c, w in (("n_MASS_1", 0.3), ("n_MASS_2", 2.0), ("n_MASS_3", 7.0), ("n_MASS_4", 14.0), ("n_MASS_5", 25.0)) for v in (c, w)]), F.col("model_id"))
    h2 = resample.iid_bootstrap_wls(ladder.where("model_id like 'n_MASS%'").withColumn("kg", kg).select("city", "kg", "beta", "se"), [], "kg", "beta", 1 / (F.col("se") * F.col("se")), reps=4000, seed=3)
    h3 = specs.mediation(d, ["city"], "n_total", "slope_deg", ["elev"], [], off)
    from pyspark.sql import Window
    w = Window.partitionBy("city")
    h4 = (ladder.where("model_id != 'n_NO_LOOT'").withColumn("mvt_rank", F.row_number().over(w.orderBy("beta")))
                .withColumn("n_classes", F.count("*").over(w)).where("model_id = 'n_MVT'"))
    tot = ppml.coef_row(ppml.ppml_fe(d, [Spec("m", "n_total", ["slope_deg"], off)], ["city"])).select("city", "beta", "se")
    return meta.hypothesis_report(h1, h2, h3, h4, tot.where("city in ('city_3', 'city_4')"), tot.where("city not in ('city_3', 'city_4')"))
