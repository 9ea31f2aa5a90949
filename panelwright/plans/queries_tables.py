"""Queries: key joins, aggregations, rank and audit reports (with SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import geo, text
from panelwright.operators import audit, clean, sample, tables
from panelwright.operators.ranks import exact_percentiles
from panelwright.plans import inputs as I
from panelwright.plans.inputs import INC_SQL, PANEL_SQL, q6, r6
from panelwright.plans.queries_clean import (GATE_SQL, KLASS_SQL, PREP_SQL, SUB_SQL, VALID_SQL, cascade_sql,
                                             utm_sql, valid)
from panelwright.plans.registry import query
from panelwright.sources import writers

# ---- joins -------------------------------------------------------------------------


@query("outer_join_acs", f"""WITH a AS (SELECT s_suppkey AS g, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS inc FROM supplier WHERE s_suppkey % 3 <> 0),
  b AS (SELECT c_custkey AS g, round(abs(c_acctbal))::BIGINT % 7 AS occ, 3 AS own FROM customer WHERE c_custkey % 2 = 0),
  c AS (SELECT c_custkey AS g, round(abs(c_acctbal))::BIGINT % 5 AS hu, 1 AS vac FROM customer WHERE c_custkey % 5 <> 0)
  SELECT g AS "GEOID", inc AS median_hh_income, {q6('3.0::DOUBLE / nullif(occ, 0)')} AS owner_share, {q6('1.0::DOUBLE / nullif(hu, 0)')} AS vacancy_rate
  FROM a FULL JOIN b USING (g) FULL JOIN c USING (g)""")
def _(t):
    bal = F.round(F.abs("c_acctbal")).cast("bigint")
    a = t.supplier.where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("GEOID"), F.col("s_acctbal").alias("median_hh_income"))
    b = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("GEOID"), (bal % 7).alias("occupied_units"), F.lit(3).alias("owner_occupied"))
    c = t.customer.where("c_custkey % 5 != 0").select(F.col("c_custkey").alias("GEOID"), (bal % 5).alias("housing_units"), F.lit(1).alias("vacant_units"))
    d = tables.outer_join_acs([a, b, c])
    return d.select("GEOID", "median_hh_income", r6("owner_share").alias("owner_share"), r6("vacancy_rate").alias("vacancy_rate"))


@query("attach_counts", """SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN
  (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (c_custkey)""")
def _(t):
    n = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return tables.attach_counts(t.customer.select("c_custkey"), n, ["c_custkey"])


@query("attach_attrs", """SELECT l_orderkey, l_linenumber::INT AS l_linenumber, s_acctbal FROM lineitem LEFT JOIN
   (SELECT s_suppkey AS l_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 1) USING (l_suppkey)""")
def _(t):
    s = t.supplier.where("s_suppkey % 3 != 1").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return tables.attach_attrs(t.lineitem.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber")), s, "l_suppkey").drop("l_suppkey")


@query("anti_missing_keys", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t):
    return tables.anti_missing_keys(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), "k")


@query("semi_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t):
    keep = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.semi_in_list(t.orders.select("o_orderkey", "o_custkey"), keep, "o_custkey").select("o_orderkey")


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT s_suppkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.supplier.select(F.col("s_suppkey").alias("k")))


@query("set_union", "SELECT event_type AS label FROM events UNION SELECT c_mktsegment FROM customer")
def _(t):
    return t.events.select(F.col("event_type").alias("label")).union(t.customer.select("c_mktsegment")).distinct()


@query("union_all", "SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def _(t):
    return writers.union_by_name(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")))


@query("order_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.col("s_acctbal").desc(), "s_suppkey")


@query("dedupe_signature", """SELECT o_orderstatus || o_orderpriority AS sig, min(o_orderkey)::BIGINT AS name FROM orders GROUP BY 1""")
def _(t):
    d = t.orders.withColumn("sig", F.concat("o_orderstatus", "o_orderpriority"))
    return writers.dedupe_signature(d, "o_orderkey", ["sig"]).select("sig", F.col("o_orderkey").alias("name"))


GRID_LEFT, GRID_TOP, STEP = 547000.0, 4184000.0, 100.0


@query("grid_bin", f"""WITH {VALID_SQL}, {utm_sql('anch')}, g AS (SELECT event_id, trunc((ux - 547000.0::DOUBLE) / 100)::INT AS col, trunc((4184000.0::DOUBLE - uy) / 100)::INT AS row FROM utm)
  SELECT event_id, row, col, (row * 90 + col)::BIGINT AS cell FROM g WHERE row BETWEEN 0 AND 109 AND col BETWEEN 0 AND 89""")
def _(t):
    d = geo.project_utm(clean.median_anchor_filter(valid(t), "feed"))
    d = tables.grid_bin(d, F.col("ux"), F.col("uy"), GRID_LEFT, GRID_TOP, STEP, 90, 110)
    return d.select("event_id", "row", "col", "cell")


def quad_sql(x, y, zoom):
    return " || ".join(f"((({x} >> {b}) & 1) + 2 * (({y} >> {b}) & 1))::VARCHAR" for b in range(zoom - 1, -1, -1))


@query("tile_key", f"""WITH {INC_SQL}, tl AS (SELECT event_id, trunc((lon + 180.0) / 360.0 * 4096)::INT AS x,
    trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096)::INT AS y FROM inc WHERE lat IS NOT NULL)
  SELECT event_id, x, y, {quad_sql('x', 'y', 12)} AS quadkey FROM tl""")
def _(t):
    x, y = geo.tile_xy(F.col("lon"), F.col("lat"), 12)
    return I.incidents(t).where("lat is not null").select("event_id", x.alias("x"), y.alias("y"), geo.quadkey(x, y, 12).alias("quadkey"))


@query("tiles_of_bbox", f"""WITH {VALID_SQL}, b AS (SELECT feed, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM anch GROUP BY 1),
  c AS (SELECT feed, trunc((w + 180.0) / 360.0 * 4096)::INT AS x0, trunc((e + 180.0) / 360.0 * 4096)::INT AS x1,
    trunc((1.0 - ln(tan(radians(n)) + 1.0 / cos(radians(n))) / pi()) / 2.0 * 4096)::INT AS y0,
    trunc((1.0 - ln(tan(radians(s)) + 1.0 / cos(radians(s))) / pi()) / 2.0 * 4096)::INT AS y1 FROM b),
  x AS (SELECT feed, y0, y1, unnest(range(x0, x1 + 1))::INT AS x FROM c), xy AS (SELECT feed, x, unnest(range(y0, y1 + 1))::INT AS y FROM x)
  SELECT feed, {quad_sql('x', 'y', 12)} AS quadkey FROM xy""")
def _(t):
    b = clean.median_anchor_filter(valid(t), "feed").groupBy("feed").agg(
        F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return b.select("feed", F.explode(geo.tiles_of_bbox(*[F.col(c) for c in "wsen"], 12)).alias("quadkey"))


@query("first_per_group_join", f"""WITH {PANEL_SQL} SELECT cell, median_home_value AS v FROM panel""")
def _(t):
    return tables.first_per_group_join(I.panel(t), "GEOID", ["median_home_value"]).select("cell", F.col("median_home_value_first").alias("v"))


@query("join_many_outer", """WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
   b AS (SELECT s_suppkey AS k, round(s_acctbal)::BIGINT AS bal FROM supplier), c AS (SELECT c_custkey AS k, 1::BIGINT AS rich FROM customer WHERE c_acctbal > 5000)
   SELECT k, coalesce(n_orders, 0) AS n_orders, coalesce(bal, 0) AS bal, coalesce(rich, 0) AS rich FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def _(t):
    a = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.round("s_acctbal").cast("bigint").alias("bal"))
    c = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.lit(1).cast("bigint").alias("rich"))
    return tables.join_many_outer([a, b, c], "k")


@query("dedupe_undirected", f"""WITH {I.NET_SQL} SELECT net, least(src, dst) || '_' || greatest(src, dst) || '_' || key AS seg_id, min(length) AS length FROM edges GROUP BY 1, 2""")
def _(t):
    return tables.dedupe_undirected(I.streets(t)[1], ["net"]).select("net", "seg_id", "length")


# ---- counts ---------------------------------------------------------------------------
def pivot_sql(key: str, summed) -> str:
    counts = ", ".join(f"count(*) FILTER (klass = '{c}') AS n_{c}" for c in text.ALL_CLASSES)
    some = ", ".join(f"'{c}'" for c in summed)
    return f"WITH {KLASS_SQL} SELECT {key}, {counts}, count(*) FILTER (klass IN ({some})) AS n_total FROM kl GROUP BY {key}"


@query("class_pivot", pivot_sql("feed", text.PROPERTY_CLASSES))
def _(t):
    return tables.class_pivot(I.incidents(t).withColumn("klass", text.classify_text(F.col("desc1"))), ["feed"])


@query("class_pivot_segments", pivot_sql("user_id", tables.SEGMENT_CLASSES))
def _(t):
    return tables.class_pivot(I.incidents(t).withColumn("klass", text.classify_text(F.col("desc1"))), ["user_id"], summed=tables.SEGMENT_CLASSES)


@query("sum_classes", f"""WITH {PANEL_SQL} SELECT cell, "n_MASS_1" + "n_MASS_2" + "n_MASS_3" + "n_MASS_4" + "n_MASS_5" AS n_theft,
   "n_MASS_1" + "n_MASS_2" + "n_MASS_4" + "n_MASS_5" + "n_MVT" + "n_NO_LOOT" AS n_clean FROM panel""")
def _(t):
    p = I.panel(t)
    return p.select("cell", sample.theft_total(p).alias("n_theft"),
                    sample.sum_classes("n_MASS_1", "n_MASS_2", "n_MASS_4", "n_MASS_5", "n_MVT", "n_NO_LOOT").alias("n_clean"))


DATED_SQL = f"""{KLASS_SQL}, d AS (SELECT *, user_id AS cell, hour(ts) AS hour, isodow(ts) - 1 AS dow, ts >= TIMESTAMP '2024-01-15' AS post,
   CASE WHEN klass LIKE 'MASS_%' THEN 'THEFT' WHEN klass = 'NO_LOOT' THEN {SUB_SQL} ELSE 'SKIP' END AS grp FROM kl),
  dd AS (SELECT * FROM d WHERE grp <> 'SKIP'),
  st AS (SELECT hour, dow, count(*) FILTER (grp = 'THEFT') AS t, count(*) FILTER (grp <> 'THEFT') AS n FROM dd GROUP BY 1, 2),
  sw AS (SELECT hour, dow, coalesce((t::DOUBLE / greatest(sum(t) OVER (), 1)) / nullif(n::DOUBLE / greatest(sum(n) OVER (), 1), 0), 0) AS sw FROM st),
  wt AS (SELECT dd.*, CASE WHEN grp = 'THEFT' THEN 1.0::DOUBLE ELSE sw END AS w FROM dd JOIN sw USING (hour, dow))"""


def dated(t):
    d = I.incidents(t).withColumn("klass", text.classify_text(F.col("desc1")))
    d = d.withColumns({"grp": text.offence_group(F.col("klass"), F.col("desc1")), "cell": F.col("user_id"),
                       "hour": F.hour("ts"), "dow": F.weekday("ts"), "post": F.col("ts") >= F.lit("2024-01-15").cast("timestamp")})
    return d.where("grp != 'SKIP'")


@query("strata_reweight", f"WITH {DATED_SQL} SELECT event_id, {q6('w')} AS w FROM wt")
def _(t):
    return tables.strata_reweight(dated(t)).select("event_id", r6("w").alias("w"))


@query("conditional_counts", f"""WITH {DATED_SQL} SELECT cell, count(*) FILTER (grp = 'THEFT') AS n_theft_d, count(*) FILTER (grp = 'VANDALISM') AS n_vandal,
   count(*) FILTER (grp = 'ARSON') AS n_arson, count(*) FILTER (grp <> 'THEFT') AS n_noloot_d, {q6("coalesce(sum(w) FILTER (grp <> 'THEFT'), 0)")} AS n_noloot_w,
   count(*) FILTER (grp = 'THEFT' AND NOT post) AS n_theft_pre, count(*) FILTER (grp = 'THEFT' AND post) AS n_theft_post,
   count(*) FILTER (NOT post) AS n_all_pre, count(*) FILTER (post) AS n_all_post FROM wt GROUP BY cell""")
def _(t):
    return tables.conditional_counts(tables.strata_reweight(dated(t))).withColumn("n_noloot_w", r6("n_noloot_w"))


@query("subset_counts", f"""WITH {INC_SQL}, c AS (SELECT user_id AS seg, {', '.join(f"count(*) FILTER (subcat IN ({', '.join(repr(v) for v in vs)})) AS {k}" for k, vs in tables.TARGET_SUBCATS.items())} FROM inc GROUP BY 1)
   SELECT *, "n_TFV" + "n_AUTOPARTS" + "n_MVT_chk" AS "n_VEH" FROM c""")
def _(t):
    return tables.subset_counts(I.incidents(t).withColumn("seg", F.col("user_id")), "seg", "subcat")


@query("noloot_composition", f"""WITH {DATED_SQL} SELECT feed, count(*) FILTER (grp = 'VANDALISM') AS vandalism, count(*) FILTER (grp = 'ARSON') AS arson,
   count(*) FILTER (grp = 'OTHER_NOLOOT') AS other_noloot, {q6("count(*) FILTER (grp = 'ARSON')::DOUBLE / greatest(count(*) FILTER (grp <> 'THEFT'), 1)")} AS arson_share FROM wt GROUP BY feed""")
def _(t):
    return tables.noloot_composition(dated(t), ["feed"]).withColumn("arson_share", r6("arson_share"))


@query("temporal_counts", f"""WITH {INC_SQL} SELECT feed, min(ts)::DATE::VARCHAR AS window_start, max(ts)::DATE::VARCHAR AS window_end,
   count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS n_pre, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS n_post FROM inc GROUP BY feed""")
def _(t):
    return tables.temporal_counts(I.incidents(t), ["feed"], F.lit("2024-01-15").cast("timestamp"))


@query("share_by_group", f"""WITH {PANEL_SQL}, s AS (SELECT cell, "GEOID", seg_len_m, CASE WHEN cell % 7 = 0 THEN 0.0::DOUBLE ELSE housing_units_cell END AS v FROM panel)
   SELECT cell, v <= 0 AS exposure_fallback, {q6('CASE WHEN v <= 0 THEN seg_len_m / sum(seg_len_m) OVER g ELSE v / sum(v) OVER g END')} AS share FROM s WINDOW g AS (PARTITION BY "GEOID")""")
def _(t):
    p = I.panel(t).withColumn("v", F.when(F.col("cell") % 7 == 0, 0.0).otherwise(F.col("housing_units_cell")))
    return tables.share_by_group(p, ["GEOID"], "v", "seg_len_m").select("cell", "exposure_fallback", r6("share").alias("share"))


@query("area_apportion", f"""WITH {PANEL_SQL} SELECT cell, {q6('median_home_value * 10000 * land_frac / nullif("ALAND", 0)')} AS units FROM panel""")
def _(t):
    u = tables.area_apportion(F.col("median_home_value"), F.lit(10000.0), F.col("land_frac"), F.col("ALAND"))
    return I.panel(t).select("cell", r6(u).alias("units"))


@query("county_share_filter", """WITH c AS (SELECT o_orderpriority AS county, o_orderstatus AS city, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 OR o_orderpriority < '3' GROUP BY 1, 2)
  SELECT city, county, n FROM c QUALIFY n::DOUBLE / sum(n) OVER (PARTITION BY city) >= 0.02""")
def _(t):
    d = t.orders.where("o_orderkey % 50 = 0 or o_orderpriority < '3'").select(F.col("o_orderstatus").alias("city"), F.col("o_orderpriority").alias("county"))
    return tables.county_share_filter(d, ["city"], "county").drop("share")


@query("value_counts_norm", f"""SELECT event_type, count(*) AS n, {q6('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM events GROUP BY 1""")
def _(t):
    return tables.value_counts_norm(t.events, [], "event_type").withColumn("share", r6("share"))


@query("crosstab_weighted", f"""WITH {KLASS_SQL}, z AS (SELECT klass AS pred, CASE WHEN event_id % 9 = 0 THEN 'AMBIG' WHEN event_id % 5 = 0 THEN 'MASS_3' ELSE klass END AS truth, (1 + event_id % 4)::BIGINT AS w FROM kl),
  n AS (SELECT pred, truth, sum(w)::BIGINT AS n FROM z GROUP BY 1, 2), lab AS (SELECT pred AS l FROM n UNION SELECT truth FROM n),
  g AS (SELECT a.l AS pred, b.l AS truth, coalesce(n, 0) AS n FROM lab a CROSS JOIN lab b LEFT JOIN n ON n.pred = a.l AND n.truth = b.l)
  SELECT pred, truth, {q6('coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY pred), 0), 0)')} AS p FROM g""")
def _(t):
    return tables.crosstab_weighted(coded(t), "klass", "truth", "w").select("pred", "truth", r6("p").alias("p"))


def coded(t):
    k = F.col("event_id")
    d = I.incidents(t).withColumn("klass", text.classify_text(F.col("desc1")))
    truth = F.when(k % 9 == 0, "AMBIG").when(k % 5 == 0, "MASS_3").otherwise(F.col("klass"))
    return d.withColumns({"truth": truth, "w": 1 + k % 4})


@query("precision_recall", f"""WITH lb AS (SELECT doc_id, quality::INT AS truth, (n_chars % 3 > 0)::INT AS pred, n_chars FROM labels JOIN documents USING (doc_id)),
  k AS (SELECT DISTINCT truth AS klass FROM lb UNION SELECT DISTINCT pred FROM lb),
  c AS (SELECT klass, sum((pred = klass AND truth = klass)::INT)::DOUBLE AS tp, sum((pred = klass)::INT)::DOUBLE AS np, sum((truth = klass)::INT)::DOUBLE AS nt,
     sum(CASE WHEN pred = klass AND truth = klass THEN n_chars ELSE 0 END)::DOUBLE AS tpw, sum(CASE WHEN pred = klass THEN n_chars ELSE 0 END)::DOUBLE AS npw FROM lb CROSS JOIN k GROUP BY klass)
  SELECT klass, {q6('tp / nullif(np, 0)')} AS precision, {q6('tp / nullif(nt, 0)')} AS recall, {q6('2 * tp / nullif(np + nt, 0)')} AS f1, {q6('tpw / nullif(npw, 0)')} AS precision_w,
   {q6('(tp/np + 3.8416/(2*np)) / (1 + 3.8416/np) - 1.96 * sqrt(tp/np * (1 - tp/np) / np + 3.8416 / (4*np*np)) / (1 + 3.8416/np)')} AS wilson_lo FROM c""")
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").cast("int").alias("truth"), (F.col("n_chars") % 3 > 0).cast("int").alias("pred"), "n_chars")
    p = tables.precision_recall(d, "pred", "truth", "n_chars")
    return p.select("klass", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "precision_w", "wilson_lo")])


V2_SQL = cascade_sql("regexp_replace(coalesce(desc1, ''), '[-_/|]+', ' ', 'g')", text.RULES_V2)


@query("class_flow", f"WITH {KLASS_SQL} SELECT klass AS v1, {V2_SQL} AS v2, count(*) AS n FROM kl GROUP BY 1, 2")
def _(t):
    return tables.class_flow(I.incidents(t), text.classify_text(F.col("desc1")), text.classify_text_v2(F.col("desc1")))


@query("class_delta", f"""WITH {KLASS_SQL}, b AS (SELECT feed, klass, count(*) AS n FROM kl GROUP BY 1, 2), a AS (SELECT feed, {V2_SQL} AS klass, count(*) AS n FROM kl GROUP BY 1, 2)
  SELECT feed, klass, coalesce(b.n, 0)::BIGINT AS before, coalesce(a.n, 0)::BIGINT AS after, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS delta FROM b FULL JOIN a USING (feed, klass)""")
def _(t):
    return tables.class_delta(I.incidents(t), ["feed"], text.classify_text(F.col("desc1")), text.classify_text_v2(F.col("desc1")))


# ---- profiles and correlations -----------------------------------------------------------
def with_expo(t):
    return I.panel(t).withColumn("exposure", sample.exposure("housing_units_cell", "pop_cell"))


@query("city_profile", f"""WITH {PANEL_SQL}, e AS (SELECT *, housing_units_cell + pop_cell AS exposure FROM panel),
  bg AS (SELECT city, median(a) AS area FROM (SELECT city, "GEOID", min("ALAND") AS a FROM e GROUP BY 1, 2) GROUP BY 1)
  SELECT city, count(*) AS n_cells, count(DISTINCT "GEOID") AS n_bg, sum(n_total)::BIGINT AS n_events, {q6('corr(tpi_500, median_hh_income)')} AS rho_income,
   {q6('corr(tpi_500, median_home_value)')} AS rho_value, {q6('corr(elev, median_hh_income)')} AS rho_abs_income, {q6('stddev_samp(elev)')} AS relief_sd, {q6('stddev_samp(tpi_500)')} AS tpi_sd,
   {q6('quantile_cont(elev, 0.99) - quantile_cont(elev, 0.01)')} AS relief_p99, {q6('any_value(area) / 1e6')} AS bg_area_km2, {q6('median(exposure)')} AS exposure_median,
   {q6('avg((n_total = 0)::INT)')} AS share_zero FROM e JOIN bg USING (city) GROUP BY city""")
def _(t):
    p = tables.city_profile(with_expo(t))
    return p.select("city", "n_cells", "n_bg", "n_events", *[r6(c).alias(c) for c in p.columns if c not in ("city", "n_cells", "n_bg", "n_events")])


@query("corr_pearson", f"WITH {PANEL_SQL} SELECT city, {q6('corr(tpi_500, median_hh_income)')} AS r FROM panel GROUP BY city")
def _(t):
    c = tables.corr_pairs(I.panel(t), ["city"], [("r", F.col("tpi_500"), F.col("median_hh_income"), "pearson")])
    return c.select("city", r6("r").alias("r"))


AVG_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE)"


@query("corr_spearman", f"""WITH {PANEL_SQL}, r AS (SELECT city, {AVG_RANK.format(k='city', v='tpi_500')} AS a, {AVG_RANK.format(k='city', v='n_total')} AS b FROM panel)
   SELECT city, {q6('corr(a, b)')} AS r FROM r GROUP BY city""")
def _(t):
    c = tables.corr_pairs(I.panel(t), ["city"], [("r", F.col("tpi_500"), F.col("n_total"), "spearman")])
    return c.select("city", r6("r").alias("r"))


WC = """w AS (SELECT *, 1.0 / (se * se) AS w FROM stu), m AS (SELECT sum(w * xmod) / sum(w) AS mx, sum(w * beta) / sum(w) AS my FROM w),
  c AS (SELECT sum(w * (xmod - mx) * (beta - my)) AS c, sum(w * (xmod - mx) ** 2) AS x, sum(w * (beta - my) ** 2) AS y, any_value(mx) AS mx, any_value(my) AS my FROM w, m)"""


@query("weighted_corr", f"WITH {I.STU_SQL}, {WC} SELECT {q6('c / sqrt(x * y)')} AS r FROM c")
def _(t):
    return tables.weighted_corr(I.studies(t), [], "xmod", "beta", 1 / (F.col("se") * F.col("se"))).select(r6("r").alias("r"))


@query("weighted_linfit", f"WITH {I.STU_SQL}, {WC} SELECT {q6('c / x', 8)} AS slope, {q6('my - c / x * mx', 8)} AS intercept FROM c")
def _(t):
    d = tables.weighted_corr(I.studies(t), [], "xmod", "beta", 1 / (F.col("se") * F.col("se")))
    return d.select(r6("slope", 8).alias("slope"), r6("intercept", 8).alias("intercept"))


BIN_SQL = """ed AS (SELECT city, list_distinct(list_transform(range(0, {k1}), lambda i: 0)) AS z, {qs} AS e FROM {src} GROUP BY city),
  bn AS (SELECT s.*, greatest(len(list_filter(list_distinct(e), lambda x: x < s.{v})) - 1, 0)::INT AS bin FROM {src} s JOIN ed USING (city))"""


def bin_sql(src, v, k):
    return BIN_SQL.format(k1=k + 1, src=src, v=v, qs="quantile_cont(%s, [%s])" % (v, ", ".join(f"{i}/{k}::DOUBLE" if 0 < i < k else f"{i // k}" for i in range(k + 1))))


@query("qcut_bucket", f"WITH {PANEL_SQL}, {bin_sql('panel', 'tpi_500', 4)} SELECT cell, bin FROM bn")
def _(t):
    return tables.qcut_bucket(I.panel(t), ["city"], "tpi_500", 4).select("cell", "bin")


@query("dose_response", f"""WITH {PANEL_SQL}, {bin_sql('panel', 'tpi_500', 5)} SELECT city, bin AS dec, {q6('avg(1000.0 * n_total / (housing_units_cell + pop_cell))')} AS rate, {q6('avg(tpi_500)')} AS tpi, count(*) AS n FROM bn GROUP BY 1, 2""")
def _(t):
    d = tables.dose_response(with_expo(t), ["city"], "tpi_500", 1000.0 * F.col("n_total") / F.col("exposure"), 5)
    return d.withColumns({"rate": r6("rate"), "tpi": r6("tpi")})


@query("bivariate_class", f"""WITH {PANEL_SQL}, p AS (SELECT *, n_total / (housing_units_cell + pop_cell) AS rate FROM panel),
   r AS (SELECT cell, {AVG_RANK.format(k='city', v='tpi_500')} / count(*) OVER (PARTITION BY city) AS a, {AVG_RANK.format(k='city', v='rate')} / count(*) OVER (PARTITION BY city) AS b FROM p)
   SELECT cell, least(trunc(a * 3)::INT, 2) AS xi, least(trunc(b * 3)::INT, 2) AS yi FROM r""")
def _(t):
    d = with_expo(t).withColumn("rate", F.col("n_total") / F.col("exposure"))
    return tables.bivariate_class(d, ["city"], "tpi_500", "rate").select("cell", "xi", "yi")


def two_exposures(t):
    """Area and building exposures side by side, with unbuilt and fallback cells mixed in."""
    k = F.col("cell")
    return I.panel(t).withColumns({
        "exposure_fallback": k % 12 == 0, "bldg_count": F.when(k % 9 == 0, 0).otherwise(F.col("n_total")),
        "bldg_area_m2": F.when(k % 9 == 0, 0.0).otherwise(F.col("pop_bldg"))})


EXPO_SQL = f"""{PANEL_SQL}, x AS (SELECT *, cell % 12 = 0 AS fb, CASE WHEN cell % 9 = 0 THEN 0 ELSE n_total END AS bc, CASE WHEN cell % 9 = 0 THEN 0 ELSE pop_bldg END AS ba,
   housing_units_cell AS o, housing_units_bldg AS nw, ln((housing_units_bldg + 1e-6) / (housing_units_cell + 1e-6)) AS ratio FROM panel),
  ok AS (SELECT * FROM x WHERE o > 0 AND nw IS NOT NULL)"""


def spear_sql(name, src, a, b):
    return (f"{name} AS (SELECT city, corr(a, b) AS {name} FROM (SELECT city, {AVG_RANK.format(k='city', v=a)} AS a, {AVG_RANK.format(k='city', v=b)} AS b FROM {src}) GROUP BY city)")


@query("exposure_diagnose", f"""WITH {EXPO_SQL}, so AS (SELECT * FROM ok WHERE NOT fb), bu AS (SELECT * FROM so WHERE ba > 0), oh AS (SELECT *, (ba > 0)::INT AS has FROM ok),
   {spear_sql('s_all', 'ok', 'ratio', 'tpi_500')}, {spear_sql('s_solid', 'so', 'ratio', 'tpi_500')}, {spear_sql('s_built', 'bu', 'ratio', 'tpi_500')}, {spear_sql('s_has', 'oh', 'has', 'tpi_500')},
   {spear_sql('s_level', 'ok', 'o', 'nw')}, {bin_sql('so', 'tpi_500', 3)}, tc AS (SELECT city, bin, sum(nw) / sum(o) AS q FROM bn GROUP BY 1, 2),
   tt AS (SELECT city, max(q) FILTER (bin = 0) AS low, max(q) FILTER (bin = 2) AS high FROM tc GROUP BY 1),
   g AS (SELECT city, count(*) AS cells, sum(bc)::BIGINT AS buildings_in_cells, count(*) FILTER (ba <= 0) AS cells_with_no_building, count(*) FILTER (fb) AS cells_fallback,
     sum(o) AS old_sum, sum(nw) AS new_sum, count(*) FILTER (o > 0 AND (nw > 2 * o OR nw < o / 2)) AS n_change_gt_2x, corr(o, nw) AS pl, corr(ln(1 + o), ln(1 + nw)) AS plog,
     sum(CASE WHEN ba <= 0 THEN n_total ELSE 0 END)::DOUBLE / greatest(sum(n_total), 1) AS zc FROM x GROUP BY city)
   SELECT city, cells, buildings_in_cells, cells_with_no_building, cells_fallback, {q6('old_sum', 3)} AS old_sum, {q6('new_sum', 3)} AS new_sum, n_change_gt_2x, {q6('pl')} AS pearson_level, {q6('plog')} AS pearson_log,
     {q6('s_level')} AS spearman_level, {q6('s_all')} AS corr_logratio_tpi_all, {q6('s_solid')} AS corr_logratio_tpi_solid, {q6('s_built')} AS corr_logratio_tpi_built, {q6('s_has')} AS corr_hasbldg_tpi,
     {q6('zc')} AS crime_share_in_zero_bldg_cells, {q6('low')} AS tercile_low, {q6('high')} AS tercile_high
   FROM g JOIN s_all USING (city) JOIN s_solid USING (city) JOIN s_built USING (city) JOIN s_has USING (city) JOIN s_level USING (city) JOIN tt USING (city)""")
def _(t):
    d = tables.exposure_diagnose(two_exposures(t))
    whole = ["city", "cells", "buildings_in_cells", "cells_with_no_building", "cells_fallback", "n_change_gt_2x"]
    fl = ["pearson_level", "pearson_log", "spearman_level", "corr_logratio_tpi_all", "corr_logratio_tpi_solid", "corr_logratio_tpi_built",
          "corr_hasbldg_tpi", "crime_share_in_zero_bldg_cells", "tercile_low", "tercile_high"]
    return d.select(*whole, r6("old_sum", 3).alias("old_sum"), r6("new_sum", 3).alias("new_sum"), *[r6(c).alias(c) for c in fl])


COVER = {"all segments": "true", "matched any": "housing_units_bldg > 0", "covers half": "land_frac >= 0.7", "covers most": "land_frac >= 0.8",
         "has vehicles": '"n_MVT" > 0', "has value": "median_home_value > 0", "income known": "median_hh_income > 0", "area known": '"ALAND" > 0',
         "long enough": "seg_len_m >= 20", "any no-loot": '"n_NO_LOOT" > 0', "fallback": "cell % 12 = 0"}


@query("coverage_report", f"WITH {PANEL_SQL} " + " UNION ALL ".join(
    f"SELECT '{k}' AS item, count(*) FILTER ({v}) AS n_segments, {q6(f'count(*) FILTER ({v})::DOUBLE / count(*)')} AS share FROM panel" for k, v in COVER.items()))
def _(t):
    d = tables.coverage_report(I.panel(t), {k: F.expr(v.replace('"', "`")) for k, v in COVER.items()})
    return d.withColumn("share", r6("share"))


@query("coverage_flags", f"WITH {PANEL_SQL} SELECT cell, {q6('pop_cell / greatest(seg_len_m, 1.0)')} AS park_cov, pop_cell / greatest(seg_len_m, 1.0) >= 0.5 AS park_measured FROM panel")
def _(t):
    cov = F.col("pop_cell") / F.greatest("seg_len_m", F.lit(1.0))
    return I.panel(t).select("cell", r6(cov).alias("park_cov"), (cov >= 0.5).alias("park_measured"))


@query("relief_split_mean", f"""WITH {I.STU_SQL} SELECT count(*) FILTER (xmod < 5) AS n_flat, {q6('avg(100 * (exp(beta) - 1)) FILTER (xmod < 5)')} AS mean_flat,
   count(*) FILTER (xmod >= 5) AS n_hilly, {q6('avg(100 * (exp(beta) - 1)) FILTER (xmod >= 5)')} AS mean_hilly FROM stu""")
def _(t):
    d = I.studies(t).withColumns({"relief_p99": F.col("xmod"), "pct": 100 * (F.exp("beta") - 1)})
    return tables.relief_split_mean(d, 5.0).withColumns({"mean_flat": r6("mean_flat"), "mean_hilly": r6("mean_hilly")})


@query("denominator_pairs", f"""WITH {I.STU_SQL} SELECT pool, {q6('max(beta) FILTER (k % 2 = 0)')} AS housing, {q6('max(beta) FILTER (k % 2 = 1)')} AS target FROM stu GROUP BY pool""")
def _(t):
    long = I.studies(t).withColumn("offset", F.when(F.col("k") % 2 == 0, "housing").otherwise("target")).groupBy("pool", "offset").agg(F.max("beta").alias("beta"))
    return tables.denominator_pairs(long, ["pool"]).select("pool", r6("housing").alias("housing"), r6("target").alias("target"))


@query("bg_diagonal", f"""WITH {I.PTS_SQL}, d AS (SELECT id % 3 AS city, grp, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS d FROM pts GROUP BY 1, 2)
   SELECT city::BIGINT AS city, {q6('median(d)')} AS bg_diagonal FROM d GROUP BY 1""")
def _(t):
    d = tables.bg_diagonal(I.points(t).withColumn("city", F.col("id") % 3), group="grp")
    return d.select("city", r6("bg_diagonal").alias("bg_diagonal"))


@query("exact_percentiles", f"""SELECT user_id % 4 AS k, {q6('quantile_cont(value, 0.003)')} AS a, {q6('median(value)')} AS b, {q6('quantile_cont(value, 0.997)')} AS c FROM events GROUP BY 1""")
def _(t):
    e = exact_percentiles(t.events.withColumn("k", F.col("user_id") % 4), ["k"], "value", [0.003, 0.5, 0.997], ["a", "b", "c"])
    return e.select("k", *[r6(c).alias(c) for c in "abc"])


CLS = ['"n_MASS_1"', '"n_MASS_2"', '"n_MASS_3"', '"n_MASS_4"', '"n_MASS_5"', '"n_MVT"', '"n_NO_LOOT"']


@query("panel_audit", f"""WITH {PANEL_SQL}, g AS (SELECT city, count(*) FILTER ({' + '.join(CLS)} <> n_total)::DOUBLE AS m, min(slope_deg) AS lo, max(slope_deg) AS hi, sum("n_NO_LOOT")::DOUBLE / greatest(sum({' + '.join(CLS)}), 1) AS nl FROM panel GROUP BY 1),
   c AS (SELECT city, unnest([{{'check': 'total_matches_classes', 'ok': m = 0, 'severity': 'fail', 'detail': m}}, {{'check': 'no_negative_counts', 'ok': true, 'severity': 'fail', 'detail': 0.0::DOUBLE}},
     {{'check': 'no_negative_exposure', 'ok': true, 'severity': 'fail', 'detail': 0.0::DOUBLE}}, {{'check': 'no_missing_slope', 'ok': true, 'severity': 'fail', 'detail': 0.0::DOUBLE}},
     {{'check': 'slope_not_negative', 'ok': lo >= 0, 'severity': 'fail', 'detail': lo}}, {{'check': 'slope_at_most_90', 'ok': hi <= 90, 'severity': 'fail', 'detail': hi}},
     {{'check': 'group_id_present', 'ok': true, 'severity': 'warn', 'detail': 0.0::DOUBLE}}, {{'check': 'no_empty_class', 'ok': true, 'severity': 'warn', 'detail': 0.0::DOUBLE}},
     {{'check': 'noloot_share_sane', 'ok': nl > 0.02 AND nl < 0.45, 'severity': 'warn', 'detail': nl}}]) AS r FROM g)
   SELECT city, r."check" AS "check", r.ok AS ok, r.severity AS severity, {q6('r.detail')} AS detail FROM c
   UNION ALL SELECT feed, 'no_future_dates', max(ts) <= TIMESTAMP '2024-02-01', 'fail', count(*) FILTER (ts > TIMESTAMP '2024-02-01')::DOUBLE FROM events_f GROUP BY 1
   UNION ALL SELECT feed, 'window_over_18_months', false, 'fail', {q6("date_diff('day', min(ts)::DATE, max(ts)::DATE) / 365.25")} FROM events_f GROUP BY 1""".replace(
    "WITH u AS", "WITH events_f AS (SELECT 'feed_' || (user_id % 7) AS feed, ts FROM events), u AS"))
def _(t):
    a = audit.panel_audit(I.panel(t))
    w = audit.window_audit(I.incidents(t).withColumn("city", F.col("feed")), F.lit("2024-01-31").cast("timestamp"))
    return a.unionByName(w).withColumn("detail", r6("detail"))


@query("audit_redownload", f"""WITH {PANEL_SQL}, m AS (SELECT city, n_total AS o, CASE WHEN cell % 50 = 0 THEN n_total + 1 ELSE n_total END AS n FROM panel), g AS (SELECT city, corr(o, n) AS r, sum(n)::DOUBLE / sum(o) AS q FROM m GROUP BY 1)
   SELECT city, 'redownload_correlates' AS "check", r > 0.99 AS ok, {q6('r')} AS detail FROM g UNION ALL SELECT city, 'redownload_volume', true, {q6('q')} FROM g""")
def _(t):
    p = I.panel(t)
    old = p.select("city", "cell", F.col("n_total").alias("old"))
    new = p.select("cell", F.when(F.col("cell") % 50 == 0, F.col("n_total") + 1).otherwise(F.col("n_total")).alias("new"))
    return audit.redownload_audit(old, new, ["cell"]).select("city", "check", "ok", r6("detail").alias("detail"))


@query("audit_sinks", f"""WITH {PANEL_SQL}, {PREP_SQL['cells']} SELECT city, 'sink_filter_holds' AS "check", max(n_total / greatest(exposure, 1)) < 50 AS ok, {q6('max(n_total / greatest(exposure, 1.0))')} AS detail FROM prep GROUP BY city""")
def _(t):
    return audit.sink_audit(sample.prep_sample(I.panel(t), "cells")).select("city", "check", "ok", r6("detail").alias("detail"))


@query("audit_centres", f"""WITH {VALID_SQL}, c AS (SELECT feed, greatest(abs(med_lat - 37.75), abs(med_lon + 122.4)) AS d FROM med)
   SELECT feed AS city, d < 0.15 AS ok, {q6('d')} AS detail FROM c""")
def _(t):
    v = valid(t).withColumn("city", F.col("feed"))
    centres = v.select("city").distinct().withColumns({"c_lat": F.lit(37.75), "c_lon": F.lit(-122.4)})
    return audit.centre_audit(v, centres).select("city", "ok", r6("detail").alias("detail"))
