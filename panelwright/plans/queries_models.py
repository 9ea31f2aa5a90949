"""Queries: Poisson fixed-effects fits, their errors and diagnostics, grids and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text
from panelwright.functions.stats import pct_per_10m, pct_per_sd
from panelwright.operators import ppml, resample, sample, specs, tables
from panelwright.operators.ppml import Spec
from panelwright.plans import inputs as I
from panelwright.plans.inputs import PANEL_SQL, q6, r6
from panelwright.plans.registry import query
from panelwright.session import cut, scratch_path
from panelwright.sources import writers

OFF = "housing_units_cell"


def newton_sql(source: str, y: str, x: str, off: str, grp: str, key: str = "city", steps: int = 7) -> str:
    """Newton steps on one slope with the group effect in closed form, unrolled as CTEs."""
    out = f"""nd AS (SELECT {key} AS k, {grp} AS g, ({y})::DOUBLE AS y, ({x})::DOUBLE - avg({x}) OVER (PARTITION BY {key}, {grp}) AS x, ln({off}) AS o FROM {source} WHERE {off} > 0),
      nb0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS b FROM nd)"""
    for i in range(steps):
        out += f""", ng{i} AS MATERIALIZED (SELECT k, g, any_value(b) AS b, count(*) AS n, sum(y) AS sy, sum(e) AS se, sum(y * x) AS syx, sum(e * x) AS sex, sum(e * x * x) AS sxx
          FROM (SELECT nd.*, b, exp(b * x + o) AS e FROM nd JOIN nb{i} USING (k)) GROUP BY k, g),
        nb{i + 1} AS MATERIALIZED (SELECT k, any_value(b) + sum(syx - sy / se * sex) / (sum(sy / se * (sxx - sex * sex / se)) + 1e-10) AS b FROM ng{i} GROUP BY k)"""
    return out + f""", nfit AS (SELECT k, any_value(b) AS b, sqrt(sum((syx - sy / se * sex) ** 2) * count(*) / (count(*) - 1)) / sum(sy / se * (sxx - sex * sex / se)) AS se,
        1 / sqrt(sum(sy / se * (sxx - sex * sex / se))) AS naive, count(*) AS n_groups, sum(n)::BIGINT AS nobs, sum(sy) AS events, count(*) FILTER (sy = 0) AS n_zero,
        count(*) FILTER (n = 1) AS n_single FROM (SELECT k, g, any_value(b) AS b, count(*) AS n, sum(y) AS sy, sum(e) AS se, sum(y * x) AS syx, sum(e * x) AS sex, sum(e * x * x) AS sxx
          FROM (SELECT nd.*, b, exp(b * x + o) AS e FROM nd JOIN nb{steps} USING (k)) GROUP BY k, g) GROUP BY k)"""


def newton_pair_sql(source: str, y: str, x1: str, x2: str, off: str, grp: str, key: str = "city", steps: int = 8) -> str:
    """``newton_sql`` for two slopes: nb{steps} holds k, b1, b2 and the Hessian's entries of the last step."""
    out = f"""pd AS (SELECT {key} AS k, {grp} AS g, ({y})::DOUBLE AS y, ({x1})::DOUBLE - avg({x1}) OVER w AS x1, ({x2})::DOUBLE - avg({x2}) OVER w AS x2, ln({off}) AS o FROM {source} WHERE {off} > 0
        WINDOW w AS (PARTITION BY {key}, {grp})), pb0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM pd)"""
    for i in range(steps):
        out += f""", pg{i} AS MATERIALIZED (SELECT k, g, any_value(b1) AS b1, any_value(b2) AS b2, sum(y) AS sy, sum(e) AS se, sum(y * x1) AS y1, sum(y * x2) AS y2, sum(e * x1) AS e1, sum(e * x2) AS e2,
          sum(e * x1 * x1) AS e11, sum(e * x1 * x2) AS e12, sum(e * x2 * x2) AS e22 FROM (SELECT pd.*, b1, b2, exp(b1 * x1 + b2 * x2 + o) AS e FROM pd JOIN pb{i} USING (k)) GROUP BY k, g),
        ph{i} AS (SELECT k, any_value(b1) AS b1, any_value(b2) AS b2, sum(y1 - sy / se * e1) AS s1, sum(y2 - sy / se * e2) AS s2, sum(sy / se * (e11 - e1 * e1 / se)) + 1e-10 AS h11,
          sum(sy / se * (e12 - e1 * e2 / se)) AS h12, sum(sy / se * (e22 - e2 * e2 / se)) + 1e-10 AS h22 FROM pg{i} GROUP BY k),
        pb{i + 1} AS MATERIALIZED (SELECT k, b1 + (h22 * s1 - h12 * s2) / (h11 * h22 - h12 * h12) AS b1, b2 + (h11 * s2 - h12 * s1) / (h11 * h22 - h12 * h12) AS b2 FROM ph{i})"""
    return out + f", pfit AS (SELECT * FROM pb{steps})"


ONE = Spec("m", "n_returned", ["slope_deg"], OFF)
ONE_SQL = f"""{PANEL_SQL}, {newton_sql('panel', 'n_returned', 'slope_deg', OFF, '"GEOID"')}"""


def one_fit(t):
    return ppml.ppml_fe(I.panel(t), [ONE], ["city"])


@query("headline")
def _(t):
    """Flagship: clean sample, percent change per degree within group, clustered errors, per city."""
    d = sample.prep_sample(I.panel(t), "cells")
    fit = ppml.ppml_fe(d, [Spec("per_degree", "n_total", ["slope_deg_raw", *sample.SES])], ["city"])
    return ppml.coef_row(fit).select("city", "beta", "se", "irr", "pct", "lo", "hi", "z", "nobs", "events",
                                     "n_groups", "iters", "converged", "max_abs_score")


@query("ppml_fe", f"WITH {ONE_SQL} SELECT k AS city, {q6('b', 8)} AS beta, nobs, n_groups FROM nfit")
def _(t):
    return ppml.coef_row(one_fit(t)).select("city", r6("beta", 8).alias("beta"), F.col("nobs").cast("bigint").alias("nobs"), "n_groups")


@query("cluster_sandwich", f"WITH {ONE_SQL} SELECT k AS city, {q6('se', 8)} AS se FROM nfit")
def _(t):
    return ppml.coef_row(one_fit(t)).select("city", r6("se", 8).alias("se"))


@query("naive_se", f"WITH {ONE_SQL} SELECT k AS city, {q6('naive', 8)} AS se FROM nfit")
def _(t):
    return one_fit(t).select("city", r6(F.get("naive", F.lit(0)), 8).alias("se"))


@query("coef_row", f"""WITH {ONE_SQL} SELECT k AS city, {q6('exp(b)')} AS irr, {q6('100 * (exp(b) - 1)')} AS pct, {q6('100 * (exp(b - 1.96 * se) - 1)')} AS lo,
   {q6('100 * (exp(b + 1.96 * se) - 1)')} AS hi, {q6('b / se', 5)} AS z FROM nfit""")
def _(t):
    return ppml.coef_row(one_fit(t)).select("city", *[r6(c).alias(c) for c in ("irr", "pct", "lo", "hi")], r6("z", 5).alias("z"))


SPARSE = f"""{PANEL_SQL}, sp AS (SELECT *, CASE WHEN "GEOID" % 6 = 0 THEN 0 ELSE n_returned END AS yz FROM panel WHERE cell % 20 < 1 OR "GEOID" % 9 <> 0),
   {newton_sql('sp', 'yz', 'slope_deg', OFF, '"GEOID"')}"""


def sparse(t):
    return I.panel(t).where("cell % 20 < 1 or GEOID % 9 != 0").withColumn(
        "yz", F.when(F.col("GEOID") % 6 == 0, 0).otherwise(F.col("n_returned")))


@query("ppml_diagnostics", f"""WITH {SPARSE} SELECT k AS city, nobs, n_groups, n_single AS n_singleton_groups, n_zero AS n_allzero_groups, events::BIGINT AS events,
   true AS converged, true AS score_small FROM nfit""")
def _(t):
    fit = ppml.ppml_fe(sparse(t), [Spec("m", "yz", ["slope_deg"], OFF)], ["city"])
    return fit.select("city", F.col("nobs").cast("bigint").alias("nobs"), "n_groups", "n_singleton_groups", "n_allzero_groups",
                      F.col("events").cast("bigint").alias("events"), "converged", (F.col("max_abs_score") / F.col("events") < 1e-8).alias("score_small"))


@query("fitted_mu", f"""WITH {ONE_SQL}, e AS (SELECT city, cell, "GEOID" AS g, n_returned AS y, exp(b * slope_deg) * {OFF} AS e FROM panel JOIN nfit ON k = city)
   SELECT cell, {q6('e * sum(y) OVER w / sum(e) OVER w')} AS mu FROM e WINDOW w AS (PARTITION BY city, g)""")
def _(t):
    return fitted(t).select("cell", r6("mu").alias("mu"))


@query("pearson_resid", f"""WITH {ONE_SQL}, e AS (SELECT city, cell, "GEOID" AS g, n_returned AS y, exp(b * slope_deg) * {OFF} AS e FROM panel JOIN nfit ON k = city),
   m AS (SELECT cell, y, e * sum(y) OVER w / sum(e) OVER w AS mu FROM e WINDOW w AS (PARTITION BY city, g))
   SELECT cell, {q6('(y - mu) / sqrt(mu)')} AS resid FROM m""")
def _(t):
    return fitted(t).select("cell", r6("resid").alias("resid"))


def fitted(t):
    d = ppml.build_design(I.panel(t), [ONE], ["city"], carry=["cell"])
    d = ppml.centre_within(d, ["city", "model_id"])
    return ppml.fitted_mu(d, one_fit(t), ["city", "model_id"])


@query("poisson_glm", f"""WITH {PANEL_SQL}, {newton_sql('panel', 'n_returned', 'slope_deg', OFF, "'all'")},
   m AS (SELECT city, "GEOID" AS clu, n_returned AS y, slope_deg AS x, exp(b * slope_deg) * {OFF} AS e FROM panel JOIN nfit ON k = city),
   m2 AS (SELECT *, e * sum(y) OVER w / sum(e) OVER w AS mu, sum(e * x) OVER w / sum(e) OVER w AS xb FROM m WINDOW w AS (PARTITION BY city)),
   cl AS (SELECT city, clu, sum((y - mu) * (x - xb)) AS s, sum(mu * (x - xb) ** 2) AS h, count(*) AS n FROM m2 GROUP BY 1, 2),
   v AS (SELECT city, sqrt(sum(s * s) * count(*) / (count(*) - 1) * (sum(n) - 1) / (sum(n) - 2)) / sum(h) AS se FROM cl GROUP BY 1)
   SELECT city, {q6('b', 8)} AS beta, {q6('v.se', 7)} AS se FROM v JOIN nfit ON k = city""")
def _(t):
    fit = ppml.poisson_glm(I.panel(t), "n_returned", ["slope_deg"], ["city"], OFF)
    return ppml.coef_row(fit).select("city", r6("beta", 8).alias("beta"), r6("se", 7).alias("se"))


SD_SQL = "sd AS (SELECT city, stddev_samp(slope_deg) AS sd FROM panel GROUP BY 1)"


@query("pct_per_10m", f"WITH {ONE_SQL}, {SD_SQL} SELECT city, {q6('100 * (exp(b * 10 / sd) - 1)', 5)} AS pct_per_10m FROM nfit JOIN sd ON k = city")
def _(t):
    sd = I.panel(t).groupBy("city").agg(F.stddev_samp("slope_deg").alias("sd"))
    return ppml.coef_row(one_fit(t)).join(sd, "city").select("city", r6(pct_per_10m(F.col("beta"), F.col("sd")), 5).alias("pct_per_10m"))


@query("pct_per_sd", f"WITH {ONE_SQL}, {SD_SQL} SELECT city, {q6('100 * (exp(b * sd) - 1)')} AS pct_per_sd FROM nfit JOIN sd ON k = city")
def _(t):
    sd = I.panel(t).groupBy("city").agg(F.stddev_samp("slope_deg").alias("sd"))
    return ppml.coef_row(one_fit(t)).join(sd, "city").select("city", r6(pct_per_sd(F.col("beta"), F.col("sd"))).alias("pct_per_sd"))


@query("dummy_fe_check", f"""WITH {PANEL_SQL}, idn AS (SELECT * FROM panel WHERE {OFF} > 0 QUALIFY sum(n_returned) OVER (PARTITION BY city, "GEOID") > 0 AND count(*) OVER (PARTITION BY city, "GEOID") >= 3),
   {newton_sql('idn', 'n_returned', 'slope_deg', OFF, '"GEOID"')}
   SELECT k AS city, nobs::DOUBLE AS nobs, n_groups, {q6('b', 7)} AS beta, {q6('b', 7)} AS beta_dummy, {q6('se', 7)} AS se, {q6('se * sqrt((nobs - 1) / (nobs - n_groups - 1))', 7)} AS se_dummy, true AS converged FROM nfit""")
def _(t):
    """Every city in one job, a row a city."""
    d = specs.dummy_fe_check(I.panel(t), "n_returned", "slope_deg", ["city"], OFF)
    return d.select("city", "nobs", "n_groups", *[r6(c, 7).alias(c) for c in ("beta", "beta_dummy", "se", "se_dummy")], "converged")


def _ladder_sql():
    names = [f"n_{c}" for c in text.PROPERTY_CLASSES]
    arms = " UNION ALL ".join(f"""SELECT '{n}' AS kk, city, "GEOID", "{n}" AS yy, slope_deg, {OFF} FROM panel""" for n in names)
    return f"""WITH {PANEL_SQL}, long AS (SELECT *, kk || '|' || city AS ck FROM ({arms})), {newton_sql('long', 'yy', 'slope_deg', OFF, '"GEOID"', key='ck')}
      SELECT split_part(k, '|', 1) AS model_id, split_part(k, '|', 2) AS city, {q6('b', 7)} AS beta, {q6('se', 7)} AS se FROM nfit"""


@query("spec_grid", _ladder_sql())
def _(t):
    """The class ladder: seven outcomes in five cities as one batched fit."""
    fit = ppml.coef_row(ppml.ppml_fe(I.panel(t), specs.ladder_specs("slope_deg", [], offset=OFF), ["city"]))
    return fit.select("model_id", "city", r6("beta", 7).alias("beta"), r6("se", 7).alias("se"))


@query("spec_grid_radius")
def _(t):
    d = sample.prep_sample(I.panel(t), "cells").withColumn("elev_z", F.col("elev") / 10)
    fit = ppml.coef_row(ppml.ppml_fe(d, specs.radius_specs("n_total", ["tpi_500_z", "slope_deg_z", "elev_z"]), ["city"]))
    return fit.select("city", "model_id", "beta", "se", "pct", "lo", "hi", "z")


RADII = ["slope_deg", "tpi_500", "elev"]


@query("spec_grid_radius_plain", f"""WITH {PANEL_SQL}, lg AS ({' UNION ALL '.join(f"SELECT '{m}|' || city AS ck, *, {m} AS xx FROM panel" for m in RADII)}), {newton_sql('lg', 'n_total', 'xx', OFF, '"GEOID"', key='ck')}
   SELECT split_part(k, '|', 2) AS city, split_part(k, '|', 1) AS model_id, {q6('b', 7)} AS beta, {q6('se', 7)} AS se FROM nfit""")
def _(t):
    fit = ppml.coef_row(ppml.ppml_fe(I.panel(t), specs.radius_specs("n_total", RADII, [], OFF), ["city"]))
    return fit.select("city", "model_id", r6("beta", 7).alias("beta"), r6("se", 7).alias("se"))


@query("attenuation_path")
def _(t):
    return specs.attenuation_path(sample.prep_sample(cut(I.panel(t)), "cells"), ["city"], "n_total", "tpi_500_z")


@query("robustness_drop_mass3")
def _(t):
    d = sample.prep_sample(I.panel(t), "cells")
    xs = ["slope_deg_raw", *sample.SES]
    return ppml.coef_row(ppml.ppml_fe(d, [Spec("all", "n_total", xs), Spec("excl MASS_3", "n_clean", xs)], ["city"])).select(
        "city", "model_id", "beta", "se", "pct", "events")


@query("mvt_rank", _ladder_sql().replace("SELECT split_part", ", r AS (SELECT split_part", 1).replace(" FROM nfit", " FROM nfit)", 1)
       + """ SELECT city, rank::INT AS mvt_rank, n::INT AS n_classes FROM (SELECT city, model_id, row_number() OVER (PARTITION BY city ORDER BY beta) AS rank, count(*) OVER (PARTITION BY city) AS n
       FROM r WHERE model_id <> 'n_NO_LOOT') WHERE model_id = 'n_MVT'""")
def _(t):
    from pyspark.sql import Window
    names = [f"n_{c}" for c in text.THEFT_CLASSES] + ["n_MVT"]
    fit = ppml.coef_row(ppml.ppml_fe(I.panel(t), specs.ladder_specs("slope_deg", [], names, OFF), ["city"]))
    w = Window.partitionBy("city")  # a city's classes: six rows
    return (fit.withColumn("mvt_rank", F.row_number().over(w.orderBy("beta"))).withColumn("n_classes", F.count("*").over(w).cast("int"))
               .where("model_id = 'n_MVT'").select("city", "mvt_rank", "n_classes"))


@query("mediation")
def _(t):
    d = sample.prep_sample(I.panel(t), "cells").withColumns({"betweenness_z": F.col("elev") / 10, "egress_count_z": (F.col("cell") % 7) / 3.0})
    return specs.mediation(d, ["city"], "n_total", "slope_deg_raw", ["betweenness_z", "egress_count_z"])


@query("mediation_pair", f"""WITH {ONE_SQL}, {newton_pair_sql('panel', 'n_returned', 'slope_deg', 'elev', OFF, '"GEOID"')}
   SELECT k AS city, {q6('b', 7)} AS before_beta, {q6('b1', 7)} AS after_beta, {q6('CASE WHEN abs(b) > 1e-9 THEN 1 - abs(b1) / abs(b) END', 5)} AS attenuation, 1 - abs(b1) / abs(b) >= 0.4 AS supports FROM nfit JOIN pfit USING (k)""")
def _(t):
    """One mediator and no controls, so that two slopes are all there is to solve for."""
    d = specs.mediation(I.panel(t), ["city"], "n_returned", "slope_deg", ["elev"], [], OFF)
    return d.select("city", r6("before_beta", 7).alias("before_beta"), r6("after_beta", 7).alias("after_beta"), r6("attenuation", 5).alias("attenuation"), "supports")


def targets(t):
    k = F.col("cell")
    return I.panel(t).withColumns({"park_spaces": (k * 5) % 17, "front_doors": F.col("n_MASS_1") + 1, "garage_parcels": k % 3,
                                   "osm_park_cap": k % 2, "addr_units": F.col("n_MASS_2"), "resunits": F.col("n_MASS_4"), "bldg_front": k % 6,
                                   "park_cov": (k % 30) / 10.0})


@query("denominator_swap", f"""WITH {PANEL_SQL}, tg AS (SELECT *, (cell * 5) % 17 AS park FROM panel), t2 AS (SELECT * FROM tg WHERE park > 0 QUALIFY count(*) OVER (PARTITION BY city, "GEOID") >= 3),
   lg AS (SELECT 'housing|' || city AS ck, * , {OFF} AS of FROM t2 UNION ALL SELECT 'target|' || city, *, park FROM t2), {newton_sql('lg', 'n_total', 'slope_deg', 'of', '"GEOID"', key='ck')},
   f AS (SELECT split_part(k, '|', 1) AS offset_, split_part(k, '|', 2) AS city, b, se FROM nfit)
   SELECT offset_ AS "offset", city, {q6('b', 7)} AS beta, {q6('se', 7)} AS se, {q6("1 - max(abs(b)) FILTER (offset_ = 'target') OVER w / max(abs(b)) FILTER (offset_ = 'housing') OVER w", 4)} AS shrinkage FROM f WINDOW w AS (PARTITION BY city)""")
def _(t):
    d = specs.denominator_swap(targets(t), ["city"], "n_total", "slope_deg", OFF, "park_spaces", controls=[])
    return d.select("offset", "city", r6("beta", 7).alias("beta"), r6("se", 7).alias("se"), r6("shrinkage_vs_housing", 4).alias("shrinkage"))


@query("denominator_swap_samples")
def _(t):
    d = sample.prep_sample(targets(t), "targets")
    out = None
    for s in ("measured", "floored"):
        r = specs.denominator_swap(d, ["city"], "n_total", "slope_deg", "expo_housing", "expo_both", sample=s).select(
            "city", "offset", "sample", "beta", "se", "pct_per_sd", "failed", "shrinkage_vs_housing")
        out = r if out is None else out.unionByName(r)
    return out


@query("denominator_test")
def _(t):
    d = sample.prep_sample(targets(t), "targets")
    return specs.denominator_test(d, ["city"], ["park_spaces", "front_doors", "addr_units", "resunits", "bldg_front"], "slope_deg", "expo_housing").select(
        "city", F.col("model_id").alias("target"), "beta", "se", "pct", "nobs")


DENSE = {"park_spaces": "(cell * 5) % 17", "front_doors": '"n_MASS_1" + 1', "bldg_front": "cell % 6"}


@query("denominator_test_plain", f"""WITH {PANEL_SQL}, al AS ({' UNION ALL '.join(f"SELECT '{n}|' || city AS ck, *, ({e})::DOUBLE AS yy FROM panel" for n, e in DENSE.items())}),
   lg AS (SELECT * FROM al WHERE yy > 0 QUALIFY count(*) OVER (PARTITION BY ck, "GEOID") >= 3), {newton_sql('lg', 'yy', 'slope_deg', OFF, '"GEOID"', key='ck')}
   SELECT split_part(k, '|', 2) AS city, split_part(k, '|', 1) AS target, {q6('b', 7)} AS beta, {q6('se', 7)} AS se, nobs::DOUBLE AS nobs FROM nfit""")
def _(t):
    d = specs.denominator_test(targets(t), ["city"], list(DENSE), "slope_deg", OFF, [])
    return d.select("city", F.col("model_id").alias("target"), r6("beta", 7).alias("beta"), r6("se", 7).alias("se"), "nobs")


@query("temporal_split", f"""WITH {PANEL_SQL}, lg AS (SELECT 'pre|' || city AS ck, *, "n_MASS_1" + "n_MASS_2" + "n_MASS_3" AS yy FROM panel UNION ALL SELECT 'post|' || city, *, "n_MVT" FROM panel),
   {newton_sql('lg', 'yy', 'slope_deg', OFF, '"GEOID"', key='ck')}
   SELECT split_part(k, '|', 2) AS city, split_part(k, '|', 1) AS period, events::BIGINT AS events, {q6('CASE WHEN events >= 3000 THEN b END', 7)} AS beta FROM nfit""")
def _(t):
    d = I.panel(t).withColumns({"n_pre": sample.sum_classes("n_MASS_1", "n_MASS_2", "n_MASS_3"), "n_post": F.col("n_MVT")})
    s = specs.temporal_split(d, ["city"], "slope_deg", "n_pre", "n_post", [], OFF, least=3000)
    return s.select("city", "period", F.col("events").cast("bigint").alias("events"), r6("beta", 7).alias("beta"))


@query("headline_repro_check", f"WITH {ONE_SQL} SELECT k AS city, {q6('b', 6)} AS stored, {q6('b', 6)} AS recomputed, true AS ok FROM nfit")
def _(t):
    """The fit as stored once against one from the rows in another order and dealing."""
    path = scratch_path(t.spark, "headline")
    writers.sink_parquet(ppml.coef_row(one_fit(t)), path)
    other = I.panel(t).repartition(7, "cell").sortWithinPartitions(F.xxhash64("cell"))
    d = specs.headline_repro_check(t.spark.read.parquet(path), ppml.coef_row(ppml.ppml_fe(other, [ONE], ["city"])), ["city"])
    return d.select("city", r6("stored").alias("stored"), r6("recomputed").alias("recomputed"), "ok")


# ---- resampling (rows-only: the draws are hashes) -------------------------------------------
@query("cluster_bootstrap_diff")
def _(t):
    d = sample.prep_sample(I.panel(t), "cells")
    d, xs = d.withColumn("n_theft", sample.theft_total(d)), ["slope_deg_raw", *sample.SES]
    return resample.cluster_bootstrap_diff(d, Spec("theft", "n_theft", xs), Spec("noloot", "n_NO_LOOT", xs), ["city"], reps=600)


@query("spatial_block_bootstrap")
def _(t):
    spec = Spec("m", "n_total", ["slope_deg_raw", *sample.SES])
    return resample.spatial_block_bootstrap(sample.prep_sample(I.panel(t), "cells"), spec, ["city"], reps=400, tile_m=1000.0)


@query("multi_spec_bootstrap")
def _(t):
    sp = [Spec(x, "n_total", [x, *sample.SES]) for x in ("slope_deg_raw", "tpi_500_z", "elev")]
    return resample.multi_spec_bootstrap(sample.prep_sample(I.panel(t), "cells"), sp, ["city"], reps=300)


CONF_SQL = f"""{PANEL_SQL}, cf(pred, truth, p) AS (VALUES {', '.join(f"('{p}', '{q}', {v}::DOUBLE)" for p, q, v in [('MASS_1', 'MASS_1', .9), ('MASS_1', 'OTHER', .1), ('MASS_2', 'MASS_2', .8), ('MASS_2', 'MASS_3', .2), ('MASS_3', 'MASS_3', 1), ('MASS_4', 'MASS_4', .85), ('MASS_4', 'MASS_5', .15), ('MASS_5', 'MASS_5', .95), ('MASS_5', 'ROBBERY', .05), ('MVT', 'MVT', 1), ('NO_LOOT', 'NO_LOOT', .75), ('NO_LOOT', 'OTHER', .25)])}),
  ct AS (SELECT cell, unnest([{', '.join(repr(c) for c in text.PROPERTY_CLASSES)}]) AS pred, unnest([{', '.join(f'"n_{c}"' for c in text.PROPERTY_CLASSES)}]) AS n FROM panel)"""


def confusion_of(t):
    """Confusion shares derived from a taxonomy of labels present in the panel."""
    rows = [("MASS_1", "MASS_1", .9), ("MASS_1", "OTHER", .1), ("MASS_2", "MASS_2", .8), ("MASS_2", "MASS_3", .2),
            ("MASS_3", "MASS_3", 1.0), ("MASS_4", "MASS_4", .85), ("MASS_4", "MASS_5", .15), ("MASS_5", "MASS_5", .95),
            ("MASS_5", "ROBBERY", .05), ("MVT", "MVT", 1.0), ("NO_LOOT", "NO_LOOT", .75), ("NO_LOOT", "OTHER", .25)]
    return t.spark.createDataFrame(rows, "pred string, truth string, p double")


def class_counts(t, keys=("city", "cell")):
    arms = F.array(*[F.struct(F.lit(c).alias("pred"), F.col(f"n_{c}").alias("n")) for c in text.PROPERTY_CLASSES])
    return I.panel(t).select(*keys, F.explode(arms).alias("_c")).select(*keys, "_c.*")


@query("expected_relabel", f"WITH {CONF_SQL} SELECT cell, truth, {q6('sum(n * p)')} AS n FROM ct JOIN cf USING (pred) GROUP BY 1, 2")
def _(t):
    return resample.expected_relabel(class_counts(t), confusion_of(t), ["cell"]).withColumn("n", r6("n"))


@query("label_noise_draws")
def _(t):
    d = I.panel(t).withColumn("n_total", sample.sum_classes(*[f"n_{c}" for c in text.PROPERTY_CLASSES]))
    return resample.label_noise_draws(d, class_counts(t), confusion_of(t), text.PROPERTY_CLASSES, ["slope_deg"], ["city"], reps=200, offset=OFF,
                                      theft=[c for c in text.PROPERTY_CLASSES if c.startswith("MASS_")])


@query("iid_bootstrap_wls")
def _(t):
    return resample.iid_bootstrap_wls(I.studies(t), [], "xmod", "beta", 1 / (F.col("se") * F.col("se")), reps=4000)
