"""Queries: terrain fields on pixel tables (with SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import raster
from panelwright.plans import inputs as I
from panelwright.plans.inputs import PIX_SQL, q6, r6
from panelwright.plans.queries_clean import MINETTI_SQL, erf_sql
from panelwright.plans.registry import query

K = ["raster_id", "row", "col"]
KS = "raster_id, row, col"
# tiles are kept small here so that rims and tile borders are exercised by the twins
TILE = 25


@query("valid_mask", f"WITH {PIX_SQL} SELECT raster_id, count(*) AS n, count(CASE WHEN z > -5 AND z < 5000 THEN 1 END) AS n_valid FROM px GROUP BY 1")
def _(t):
    from panelwright.sources.readers import scan_pixels
    return scan_pixels(I.pixels(t)).groupBy("raster_id").agg(F.count("*").alias("n"), F.count("z").alias("n_valid"))


GRAD_SQL = f"""{PIX_SQL}, nb AS (SELECT *, lag(z) OVER r AS zl, lead(z) OVER r AS zr, lag(col) OVER r AS cl, lead(col) OVER r AS cr, lag(z) OVER c AS zu, lead(z) OVER c AS zd, lag(row) OVER c AS ru, lead(row) OVER c AS rd
   FROM px WINDOW r AS (PARTITION BY raster_id, row ORDER BY col), c AS (PARTITION BY raster_id, col ORDER BY row)),
  gr AS (SELECT *, CASE WHEN cl IS NOT NULL AND cr IS NOT NULL THEN (zr - zl) / 20 WHEN cr IS NOT NULL THEN (zr - z) / 10 WHEN cl IS NOT NULL THEN (z - zl) / 10 END AS gx,
    CASE WHEN ru IS NOT NULL AND rd IS NOT NULL THEN (zd - zu) / 20 WHEN rd IS NOT NULL THEN (zd - z) / 10 WHEN ru IS NOT NULL THEN (z - zu) / 10 END AS gy FROM nb)"""


@query("slope_deg", f"WITH {GRAD_SQL} SELECT {KS}, {q6('CASE WHEN z IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gy * gy))) END')} AS slope_deg FROM gr")
def _(t):
    return raster.slope_deg(I.pixels(t), 10.0, TILE).select(*K, r6("slope_deg").alias("slope_deg"))


@query("hillshade", f"""WITH {GRAD_SQL} SELECT {KS}, {q6('''CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN least(1, greatest(0, sin(radians(45)) * sin(pi() / 2 - atan(1.5 * sqrt(gx * gx + gy * gy)))
   + cos(radians(45)) * cos(pi() / 2 - atan(1.5 * sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-1.5 * gx, 1.5 * gy)))) END''')} AS shade FROM gr""")
def _(t):
    return raster.hillshade(I.pixels(t), 10.0, tile=TILE).select(*K, r6("shade").alias("shade"))


def disk_sql(r):
    return f"""{PIX_SQL}, fm AS (SELECT a.raster_id, a.row, a.col, any_value(a.z) AS z, count(b.z)::DOUBLE AS n, avg(b.z) AS m, sqrt(greatest(avg(b.z * b.z) - avg(b.z) ** 2, 0)) AS sd
      FROM px a JOIN px b ON a.raster_id = b.raster_id AND b.row BETWEEN a.row - {r} AND a.row + {r} AND b.col BETWEEN a.col - {r} AND a.col + {r} AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= {r * r} GROUP BY 1, 2, 3)"""


@query("focal_moments", f"WITH {disk_sql(4)} SELECT {KS}, n AS fn, {q6('m')} AS fmean, {q6('sd', 5)} AS fsd FROM fm")
def _(t):
    return raster.focal_moments(I.pixels(t), 40.0, 10.0, TILE).select(*K, "fn", r6("fmean").alias("fmean"), r6("fsd", 5).alias("fsd"))


@query("focal_moments_wide", f"WITH {disk_sql(15)} SELECT {KS}, n AS fn, {q6('m')} AS fmean, {q6('sd', 5)} AS fsd FROM fm")
def _(t):
    return raster.focal_moments(I.pixels(t), 150.0, 10.0, TILE).select(*K, "fn", r6("fmean").alias("fmean"), r6("fsd", 5).alias("fsd"))


OKD = "z IS NOT NULL AND n > 3"


@query("tpi", f"WITH {disk_sql(5)} SELECT {KS}, {q6(f'CASE WHEN {OKD} THEN z - m END')} AS tpi FROM fm")
def _(t):
    return raster.tpi(I.pixels(t), 50.0, 10.0, TILE).select(*K, r6("tpi").alias("tpi"))


@query("tpiz", f"WITH {disk_sql(5)} SELECT {KS}, {q6(f'CASE WHEN {OKD} AND sd > 1e-3 THEN (z - m) / sd END', 5)} AS tpiz FROM fm")
def _(t):
    return raster.tpi(I.pixels(t), 50.0, 10.0, TILE).select(*K, r6("tpiz", 5).alias("tpiz"))


@query("elev_percentile", f"WITH {disk_sql(5)}, q AS (SELECT {KS}, CASE WHEN {OKD} AND sd > 1e-3 THEN (z - m) / sd END AS u FROM fm) SELECT {KS}, {q6(f'CASE WHEN u IS NOT NULL THEN {erf_sql(chr(117))} END', 5)} AS pctl FROM q")
def _(t):
    return raster.tpi(I.pixels(t), 50.0, 10.0, TILE).select(*K, r6("pctl", 5).alias("pctl"))


@query("local_relief", f"""WITH {PIX_SQL} SELECT a.raster_id, a.row, a.col, {q6('CASE WHEN any_value(a.z) IS NOT NULL THEN max(b.z) - min(b.z) END')} AS relief FROM px a JOIN px b ON a.raster_id = b.raster_id
   AND b.row BETWEEN a.row - 5 AND a.row + 5 AND b.col BETWEEN a.col - 5 AND a.col + 5 GROUP BY 1, 2, 3""")
def _(t):
    return raster.local_relief(I.pixels(t), 50.0, 10.0, tile=TILE).select(*K, r6("relief").alias("relief"))


def off_sql(radius, dirs, rings):
    rows = ", ".join(f"({o.dx}, {o.dy}, {o.met}, {o.weight!r}::DOUBLE)" for o in raster.catchment(radius, 10.0, dirs, rings).itertuples())
    return f"""{PIX_SQL}, o(dx, dy, met, w) AS (VALUES {rows}), od AS (SELECT a.raster_id, a.row, a.col, a.z, b.z AS zj, met, w, sqrt((dx * 10.0) ** 2 + (dy * 10.0) ** 2) AS d,
      least(0.5::DOUBLE, greatest(-0.5::DOUBLE, (a.z - b.z) / sqrt((dx * 10.0) ** 2 + (dy * 10.0) ** 2))) AS g FROM px a CROSS JOIN o JOIN px b ON b.raster_id = a.raster_id AND b.row = a.row - dy AND b.col = a.col - dx
      WHERE a.z IS NOT NULL AND b.z IS NOT NULL)"""


def rtc_sql(kg):
    return f"sum(({MINETTI_SQL('g')} + {MINETTI_SQL('(-g)')} * (75.0 + {kg}) / 75.0) * d * w) / sum(w)"


@query("round_trip_cost", f"""WITH {off_sql(80.0, 12, 3)}, c AS (SELECT {KS}, {rtc_sql(7)} AS rtc FROM od GROUP BY 1, 2, 3) SELECT {KS}, {q6('rtc', 4)} AS rtc FROM px LEFT JOIN c USING ({KS})""")
def _(t):
    return raster.round_trip_cost(I.pixels(t), 10.0, 80.0, 7.0, n_dirs=12, n_rings=3, tile=TILE).select(*K, r6("rtc", 4).alias("rtc"))


@query("loot_penalty", f"""WITH {off_sql(80.0, 12, 3)}, c AS (SELECT {KS}, {rtc_sql(20)} - {rtc_sql(0.3)} AS p FROM od GROUP BY 1, 2, 3) SELECT {KS}, {q6('p', 4)} AS loot_penalty FROM px LEFT JOIN c USING ({KS})""")
def _(t):
    return raster.loot_penalty(I.pixels(t), 10.0, 80.0, n_dirs=12, n_rings=3, tile=TILE).select(*K, r6("loot_penalty", 4).alias("loot_penalty"))


@query("viewshed_share", f"""WITH {off_sql(100.0, 9, 4)}, c AS (SELECT {KS}, sum(met * (z > zj)::INT) / sum(met)::DOUBLE AS v FROM od GROUP BY 1, 2, 3) SELECT {KS}, {q6('v')} AS viewshed FROM px LEFT JOIN c USING ({KS})""")
def _(t):
    return raster.viewshed_share(I.pixels(t), 10.0, 100.0, 9, 4, TILE).select(*K, r6("viewshed").alias("viewshed"))


def block_sql(f, how="avg"):
    return f"""{PIX_SQL}, sz AS (SELECT raster_id, (max(row) + 1) // {f} AS h, (max(col) + 1) // {f} AS w FROM px GROUP BY 1),
      bl AS (SELECT raster_id, row // {f} AS brow, col // {f} AS bcol, {how}(z) AS z, avg((z IS NOT NULL)::INT) AS land_frac, any_value(w) AS w FROM px JOIN sz USING (raster_id) WHERE row // {f} < h AND col // {f} < w GROUP BY 1, 2, 3)"""


@query("block_mean", f"WITH {block_sql(7)} SELECT raster_id, brow::INT AS brow, bcol::INT AS bcol, {q6('z')} AS z, {q6('land_frac')} AS land_frac FROM bl WHERE land_frac > 0.25")
def _(t):
    d = raster.block_agg(I.pixels(t), 7, ["z"]).where("land_frac > 0.25")
    return d.select("raster_id", "brow", "bcol", r6("z").alias("z"), r6("land_frac").alias("land_frac"))


@query("block_max", f"WITH {block_sql(7, 'max')} SELECT raster_id, brow::INT AS brow, bcol::INT AS bcol, {q6('z')} AS z FROM bl")
def _(t):
    return raster.block_agg(I.pixels(t), 7, ["z"], "max").select("raster_id", "brow", "bcol", r6("z").alias("z"))


@query("cell_centroids", f"WITH {block_sql(10)} SELECT raster_id, (brow * w + bcol)::BIGINT AS cell, 1000 + (bcol + 0.5::DOUBLE) * 100 AS x, 9000 - (brow + 0.5::DOUBLE) * 100 AS y FROM bl")
def _(t):
    return raster.cell_centroids(raster.block_agg(I.pixels(t), 10, ["z"]), 1000.0, 9000.0, 10.0, 10).select("raster_id", "cell", "x", "y")


@query("resample_to_cells", f"""WITH {block_sql(10)}, cc AS (SELECT raster_id, (brow * w + bcol)::BIGINT AS cell, 1000 + (bcol + 0.5::DOUBLE) * 100 AS x, 9000 - (brow + 0.5::DOUBLE) * 100 AS y FROM bl),
   ex AS (SELECT raster_id, min(x) - 50 AS l, max(y) + 50 AS t FROM cc GROUP BY 1), pp AS (SELECT raster_id, floor((1000 + (col // 3 + 0.5) * 30.0::DOUBLE - l) / 100) AS gx, floor((t - (9000 - (row // 3 + 0.5) * 30.0::DOUBLE)) / 100) AS gy, avg(z) AS z
     FROM (SELECT raster_id, row // 3 * 3 AS row, col // 3 * 3 AS col, avg(z) AS z FROM px GROUP BY 1, 2, 3) JOIN ex USING (raster_id) WHERE z IS NOT NULL GROUP BY 1, 2, 3)
   SELECT raster_id, cell, {q6('z', 9)} AS z FROM (SELECT cc.*, floor((x - l) / 100) AS gx, floor((t - y) / 100) AS gy FROM cc JOIN ex USING (raster_id)) LEFT JOIN pp USING (raster_id, gx, gy)""")
def _(t):
    px = I.pixels(t)
    cells = raster.cell_centroids(raster.block_agg(px, 10, ["z"]), 1000.0, 9000.0, 10.0, 10).select("raster_id", "cell", "x", "y")
    coarse = raster.block_agg(px, 3, ["z"]).select("raster_id", F.col("brow").alias("row"), F.col("bcol").alias("col"), "z")
    return raster.resample_to_cells(coarse, "z", 1000.0, 9000.0, 30.0, cells).select("raster_id", "cell", r6("z", 9).alias("z"))


@query("resolution_compare", f"""WITH {GRAD_SQL}, s AS (SELECT {KS}, CASE WHEN z IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gy * gy))) END AS a, z FROM gr), l AS (SELECT 'slope_10m' AS source, a AS v, a AS r FROM s UNION ALL SELECT 'height', z, a FROM s)
   SELECT source, {q6('avg(v)')} AS mean_deg, {q6('stddev_samp(v)')} AS sd_deg, {q6('max(v)')} AS max_deg, {q6('quantile_cont(v, 0.1)')} AS p10_deg, {q6('quantile_cont(v, 0.5)')} AS p50_deg, {q6('quantile_cont(v, 0.9)')} AS p90_deg,
     {q6('regr_intercept(v, r)', 5)} AS vs_intercept, {q6('regr_slope(v, r)')} AS vs_slope, {q6('regr_r2(v, r)')} AS vs_r2, {q6('corr(v, r)')} AS corr_with_ref FROM l WHERE v IS NOT NULL AND r IS NOT NULL GROUP BY 1""")
def _(t):
    d = raster.slope_deg(I.pixels(t), 10.0, TILE).select(F.col("slope_deg").alias("slope_10m"), F.col("z").alias("height"))
    c = raster.resolution_compare(d, ["slope_10m", "height"], "slope_10m")
    return c.select("source", r6("vs_intercept", 5).alias("vs_intercept"), *[r6(x).alias(x) for x in c.columns if x not in ("source", "vs_intercept")])
