"""Queries: planar joins, overlays, apportioning and spatial dependence (with SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import geometry as G
from panelwright.functions.permute import permuted_sql
from panelwright.operators import dependence, ppml, spatial
from panelwright.operators.ranks import ordered_index
from panelwright.plans import inputs as I
from panelwright.plans.inputs import ARE_SQL, BLD_SQL, IN_ZONE_SQL, LIN_SQL, PANEL_SQL, PIX_SQL, PLC_SQL, PTS_SQL, ZON_SQL, q6, r6
from panelwright.plans.queries_models import OFF, ONE, ONE_SQL
from panelwright.plans.registry import query

SEGD = """(CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0 THEN sqrt((px - x1 - greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (x2 - x1)) ** 2
  + (py - y1 - greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (y2 - y1)) ** 2) ELSE sqrt((px - x1) ** 2 + (py - y1) ** 2) END)"""


def near_sql(pts, m, key="id", name="nr"):
    """Nearest line within m for rows (key, px, py) of ``pts``; a box test keeps the SQL side quick."""
    return f"""{name} AS (SELECT * FROM (SELECT {key}, seg_id, min({SEGD}) AS d FROM {pts} JOIN le ON px BETWEEN least(x1, x2) - {m} AND greatest(x1, x2) + {m}
      AND py BETWEEN least(y1, y2) - {m} AND greatest(y1, y2) + {m} GROUP BY 1, 2) WHERE d <= {m} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d, seg_id) = 1)"""


@query("pip_join", f"WITH {PLC_SQL}, {ZON_SQL} SELECT id, zone FROM plc LEFT JOIN zon ON {IN_ZONE_SQL}")
def _(t):
    return spatial.pip_join(I.places(t), I.zones(t), 300.0).select("id", "zone")


@query("pip_join_parts", f"""WITH {PLC_SQL}, {ARE_SQL} SELECT id, zone FROM plc JOIN arect ON px >= x0 AND px < x1 AND py >= y0 AND py < y1 GROUP BY 1, 2 HAVING sum(sign) = 1""")
def _(t):
    # holes, two parts, and one area that is 200 buckets wide
    return spatial.pip_join(I.places(t), I.areas(t), 30.0, ring="parts", how="inner", first=False).select("id", "zone")


@query("subset_by_place", f"""WITH {PLC_SQL}, {ZON_SQL}, b AS (SELECT * FROM zon WHERE zone % 4 = 1 ORDER BY housing_units DESC, zone DESC LIMIT 1) SELECT id FROM plc JOIN b ON {IN_ZONE_SQL}""")
def _(t):
    z = I.zones(t).withColumns({"place_name": F.concat(F.lit("p"), F.col("zone") % 4), "aland": F.col("housing_units")})
    return spatial.subset_by_place(I.places(t), z, "p1", 300.0).select("id")


@query("point_in_footprint_flag", f"""WITH {BLD_SQL}, {PLC_SQL}, h AS (SELECT DISTINCT b FROM bld JOIN plc ON px >= x0 AND px < x1 AND py >= y0 AND py < y1 AND id % 5 = 0)
   SELECT bld.b, CASE WHEN h.b IS NOT NULL AND bldg_class IN ('unknown', 'other') THEN 'commercial' ELSE bldg_class END AS bldg_class FROM bld LEFT JOIN h ON h.b = bld.b""")
def _(t):
    return spatial.point_in_footprint_flag(I.buildings(t), I.places(t).where("id % 5 = 0"), 150.0).select("b", "bldg_class")


@query("tag_footprints", f"""WITH {BLD_SQL}, {PLC_SQL}, {ARE_SQL}, z AS (SELECT b, zone FROM bld, arect r WHERE (bld.x0 + bld.x1) / 2 >= r.x0 AND (bld.x0 + bld.x1) / 2 < r.x1
     AND (bld.y0 + bld.y1) / 2 >= r.y0 AND (bld.y0 + bld.y1) / 2 < r.y1 GROUP BY 1, 2 HAVING sum(sign) = 1), m AS (SELECT b, min(zone) AS zone FROM z WHERE zone <> -1 GROUP BY 1),
   h AS (SELECT DISTINCT b FROM bld JOIN plc ON px >= x0 AND px < x1 AND py >= y0 AND py < y1 AND id % 5 = 0), c AS (SELECT b, coalesce(tag, 'unknown') AS c FROM bld LEFT JOIN m USING (b) LEFT JOIN atag USING (zone))
   SELECT c.b, CASE WHEN h.b IS NOT NULL AND c IN ('unknown', 'other') THEN 'commercial' ELSE c END AS bldg_class FROM c LEFT JOIN h ON h.b = c.b""")
def _(t):
    shapes = I.areas(t).where("zone <> -1").withColumnRenamed("zone", "shape_id")
    return spatial.tag_footprints(I.buildings(t), shapes, I.places(t).where("id % 5 = 0"), 150.0).select("b", "bldg_class")


@query("nearest_line_join", f"WITH {PLC_SQL}, {LIN_SQL}, {near_sql('plc', 60)} SELECT id, seg_id, {q6('d')} AS snap_m FROM plc LEFT JOIN nr USING (id)")
def _(t):
    return spatial.nearest_line_join(I.places(t), I.lines(t), 60.0).select("id", "seg_id", r6("snap_m").alias("snap_m"))


@query("knn_join", f"""WITH {PTS_SQL}, d AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pts a JOIN pts b ON a.id <> b.id)
   SELECT i, j, {q6('d')} AS d, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS rank FROM d QUALIFY rank <= 8""")
def _(t):
    return spatial.knn_join(I.points(t), 8).select("i", "j", r6("d").alias("d"), F.col("rank").cast("int").alias("rank"))


@query("knn_join_lattice", f"""WITH {PANEL_SQL}, c AS (SELECT cell AS id, x, y FROM panel), d AS (SELECT a.id AS i, b.id AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM c a JOIN c b ON a.id <> b.id AND abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300)
   SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= 8""")
def _(t):
    return spatial.knn_join(I.panel(t).withColumn("id", F.col("cell")), 8).select("i", "j")


@query("radius_count", f"""WITH {PTS_SQL} SELECT a.id, count(*)::DOUBLE AS n, {q6('count(*) / (pi() * 0.09 * 0.09)')} AS density FROM pts a JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 90 GROUP BY 1""")
def _(t):
    import math
    p = I.points(t)
    d = spatial.radius_sum(p, p.select("x", "y"), 90.0)
    return d.select("id", "n", r6(F.col("n") / (math.pi * 0.09 ** 2)).alias("density"))


@query("radius_pairs", f"""WITH {PTS_SQL} SELECT a.id AS i, b.id AS j, {q6('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} AS d FROM pts a JOIN pts b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 60""")
def _(t):
    return spatial.radius_pairs(I.points(t), 60.0).withColumn("d", r6("d"))


def line_pts(t):
    """Query places over the street lines: every customer's seat."""
    return I.lines(t).select(F.col("seg_id").alias("id"), F.col("line")[1]["x"].alias("x"), F.col("line")[1]["y"].alias("y"))


@query("ring_cross_count", f"""WITH {LIN_SQL}, q AS (SELECT seg_id AS id, bx AS px, bq AS py FROM lin), m AS (SELECT id, e.seg_id, min({SEGD}) AS mn, max(greatest(sqrt((px - x1) ** 2 + (py - y1) ** 2), sqrt((px - x2) ** 2 + (py - y2) ** 2))) AS mx
     FROM q JOIN le e ON x1 BETWEEN px - 600 AND px + 600 AND y1 BETWEEN py - 600 AND py + 600 GROUP BY 1, 2)
   SELECT id, count(*) FILTER (mn <= 400 AND mx >= 400) AS permeability FROM m GROUP BY id""")
def _(t):
    return spatial.ring_cross_count(line_pts(t), I.lines(t), 400.0).select("id", "permeability")


EE = lambda a, b: f"""(CASE WHEN (({b}x2 - {b}x1) * ({a}y1 - {b}y1) - ({b}y2 - {b}y1) * ({a}x1 - {b}x1)) * (({b}x2 - {b}x1) * ({a}y2 - {b}y1) - ({b}y2 - {b}y1) * ({a}x2 - {b}x1)) < 0
  AND (({a}x2 - {a}x1) * ({b}y1 - {a}y1) - ({a}y2 - {a}y1) * ({b}x1 - {a}x1)) * (({a}x2 - {a}x1) * ({b}y2 - {a}y1) - ({a}y2 - {a}y1) * ({b}x2 - {a}x1)) < 0 THEN 0 ELSE least({', '.join(
      SEGD.replace('px', f'{p}x{k}').replace('py', f'{p}y{k}').replace('(x2', f'({o}x2').replace('(y2', f'({o}y2').replace('- x1', f'- {o}x1').replace('- y1', f'- {o}y1')
      for p, o in ((a, b), (b, a)) for k in (1, 2))}) END)"""


@query("buffer_count_len", f"""WITH {LIN_SQL}, st AS (SELECT * FROM le WHERE seg_id % 6 = 0), sl AS (SELECT seg_id AS way_id, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len FROM st GROUP BY 1),
   d AS (SELECT a.seg_id, b.seg_id AS way_id, min({EE('a.', 'b.')}) AS d FROM le a JOIN st b ON abs(a.x1 - b.x1) < 400 AND abs(a.y1 - b.y1) < 400 GROUP BY 1, 2),
   n AS (SELECT seg_id, count(*) AS n, sum(len) AS len FROM d JOIN sl USING (way_id) WHERE d <= 100 GROUP BY 1)
   SELECT seg_id, coalesce(n, 0) AS n_within, {q6('coalesce(len, 0)')} AS len_within FROM lin LEFT JOIN n USING (seg_id)""")
def _(t):
    l = I.lines(t)
    ways = l.where("seg_id % 6 = 0").select(F.col("seg_id").alias("way_id"), "line")
    return spatial.buffer_count_len(l.select("seg_id", "line"), ways, 100.0).select("seg_id", "n_within", r6("len_within").alias("len_within"))


OV_SQL = f"""{BLD_SQL}, ov AS (SELECT b, area_m2, c AS col_, r AS row_, greatest(0, least(x1, (c + 0.5) * 100) - greatest(x0, (c - 0.5) * 100)) * greatest(0, least(y1, 10000 - (r - 0.5) * 100) - greatest(y0, 10000 - (r + 0.5) * 100)) / area_m2 AS frac
   FROM (SELECT *, unnest(range(floor((x0 + 50) / 100)::BIGINT, floor((x1 + 50) / 100)::BIGINT + 1)) AS c FROM (SELECT *, unnest(range(floor((10050 - y1) / 100)::BIGINT, floor((10050 - y0) / 100)::BIGINT + 1)) AS r FROM bld)))"""


@query("area_overlay", f"WITH {OV_SQL} SELECT b, row_, col_, {q6('frac')} AS frac FROM ov WHERE frac > 1e-6")
def _(t):
    return spatial.area_overlay(I.buildings(t), 100.0, 0.0, 10000.0).select("b", "row_", "col_", r6("frac").alias("frac"))


@query("area_overlay_parts", f"""WITH {ARE_SQL}, g AS (SELECT *, unnest(range(floor((x0 + 50) / 100)::BIGINT, floor((x1 + 50) / 100)::BIGINT + 1)) AS col_ FROM arect),
   c AS (SELECT *, unnest(range(floor((10050 - y1) / 100)::BIGINT, floor((10050 - y0) / 100)::BIGINT + 1)) AS row_ FROM g),
   p AS (SELECT zone, row_, col_, sum(sign * greatest(0, least(x1, col_ * 100 + 50) - greatest(x0, col_ * 100 - 50)) * greatest(0, least(y1, 10050 - row_ * 100) - greatest(y0, 9950 - row_ * 100))) AS part FROM c GROUP BY 1, 2, 3),
   a AS (SELECT zone, sum(sign * (x1 - x0) * (y1 - y0)) AS area FROM arect GROUP BY 1)
   SELECT zone, row_, col_, {q6('part / area')} AS frac FROM p JOIN a USING (zone) WHERE part / area > 1e-6""")
def _(t):
    return spatial.area_overlay(I.areas(t), 100.0, 0.0, 10000.0, key="zone", shape="parts").select("zone", "row_", "col_", r6("frac").alias("frac"))


def zone_cells(t):
    """100 m cells over the zones' squares: nine per zone, each knowing its zone."""
    z = I.zones(t).select("zone", (F.col("zone") % 20 * 3).alias("cz"), (F.floor(F.col("zone") / 20) * 3).alias("rz"))
    z = z.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    col, up = F.col("cz") + F.col("k") % 3, F.col("rz") + F.floor(F.col("k") / 3)
    return z.select("zone", (F.col("zone") * 9 + F.col("k")).alias("cell"), col.cast("bigint").alias("col_"), (100 - up).cast("bigint").alias("row_"),
                    F.when(F.col("zone") % 11 != 0, F.lit(90000.0)).alias("ALAND"), (0.5 + F.col("k") / 20.0).alias("land_frac"))


APP_SQL = f"""{OV_SQL}, {ZON_SQL}, br AS (SELECT *, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM bld), bz AS (SELECT br.*, zone, housing_units, population,
    CASE WHEN bldg_class NOT IN ('commercial', 'other') AND area_m2 >= 20 THEN area_m2 ELSE 0 END AS ra FROM br LEFT JOIN zon ON {IN_ZONE_SQL}),
  per AS (SELECT zone, sum(ra) AS tra, count(*) AS nb FROM bz WHERE zone IS NOT NULL GROUP BY 1), bu AS (SELECT bz.*, coalesce(housing_units * ra / nullif(tra, 0), 0) AS hu, coalesce(population * ra / nullif(tra, 0), 0) AS po FROM bz LEFT JOIN per USING (zone)),
  ce AS (SELECT row_, col_, sum((floor(px / 100 + 0.5) = col_ AND floor((10000 - py) / 100 + 0.5) = row_)::INT)::BIGINT AS nb, sum(bu.area_m2 * frac) AS ba, sum(ra * frac) AS rba, sum(hu * frac) AS hu, sum(po * frac) AS po FROM ov JOIN bu USING (b) WHERE frac > 1e-6 GROUP BY 1, 2),
  cl AS (SELECT s_suppkey AS zone, s_suppkey * 9 + k AS cell, s_suppkey % 20 * 3 + k % 3 AS col_, 100 - (s_suppkey // 20 * 3 + k // 3) AS row_, CASE WHEN s_suppkey % 11 <> 0 THEN 90000.0::DOUBLE END AS al, 0.5::DOUBLE + k / 20.0 AS lf FROM supplier, range(0, 9) r(k)),
  ap AS (SELECT cell, coalesce(ce.nb, 0) AS bldg_count, coalesce(ba, 0) AS ba, coalesce(rba, 0) AS rba, tra IS NULL OR tra <= 0 AS fb, housing_units * 10000 * lf / al AS fhu, population * 10000 * lf / al AS fpo, coalesce(hu, 0) AS hu, coalesce(po, 0) AS po
    FROM cl LEFT JOIN ce USING (row_, col_) LEFT JOIN per USING (zone) JOIN zon USING (zone))"""


@query("bldg_apportion", f"""WITH {APP_SQL} SELECT cell, bldg_count, {q6('ba')} AS bldg_area_m2, {q6('rba')} AS resid_bldg_area_m2, fb AS exposure_fallback, {q6('CASE WHEN fb THEN fhu ELSE hu END')} AS housing_units_bldg,
   {q6('CASE WHEN fb THEN fpo ELSE po END')} AS pop_bldg FROM ap""")
def _(t):
    d = spatial.bldg_apportion(I.buildings(t), I.zones(t), zone_cells(t), 100.0, 0.0, 10000.0, 300.0)
    return d.select("cell", "bldg_count", "exposure_fallback", *[r6(c).alias(c) for c in ("bldg_area_m2", "resid_bldg_area_m2", "housing_units_bldg", "pop_bldg")])


@query("bldg_per_cell", f"""WITH {BLD_SQL}, c AS (SELECT *, trunc(((x0 + x1) / 2) / 100)::BIGINT AS col, trunc((10000 - (y0 + y1) / 2) / 100)::BIGINT AS row FROM bld)
   SELECT (row * 65 + col)::BIGINT AS cell, count(*) FILTER (bldg_class = 'residential') AS n_doors, count(*) AS n_struct, {q6("coalesce(sum(area_m2) FILTER (bldg_class = 'residential'), 0)")} AS resid_area
   FROM c WHERE col BETWEEN 0 AND 64 AND row BETWEEN 0 AND 99 GROUP BY 1""")
def _(t):
    return spatial.bldg_per_cell(I.buildings(t), 0.0, 10000.0, 100.0, 65, 100).withColumn("resid_area", r6("resid_area"))


SAMP_SQL = """ln AS (SELECT *, sqrt((bx - ax) ** 2 + (bq - ay) ** 2) AS l1, sqrt((cx - bx) ** 2 + (cy - bq) ** 2) AS l2 FROM {src})"""
AT = lambda d: (f"CASE WHEN {d} <= l1 THEN ax + {d} / l1 * (bx - ax) ELSE bx + ({d} - l1) / l2 * (cx - bx) END", f"CASE WHEN {d} <= l1 THEN ay + {d} / l1 * (bq - ay) ELSE bq + ({d} - l1) / l2 * (cy - bq) END")
CEN_SQL = f"""{LIN_SQL}, cen AS (SELECT seg_id AS line_id, ax + 4 AS ax, ay + 3 AS ay, bx + 4 AS bx, bq + 3 AS bq, cx + 4 AS cx, cy + 3 AS cy, value FROM lin WHERE seg_id % 3 = 0), {SAMP_SQL.format(src='cen')}"""
PX, PY = AT("((i + 0.5) / n * (l1 + l2))")


@query("line_apportion", f"""WITH {CEN_SQL}, sp AS (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, greatest(ceil((l1 + l2) / 10), 1)::BIGINT AS n FROM ln)),
   sm AS (SELECT line_id * 1000 + i AS sid, value / n AS v, (l1 + l2) / n AS m, {PX} AS px, {PY} AS py FROM sp), {near_sql('sm', 25, 'sid')}
   SELECT seg_id, {q6('sum(v)')} AS value, {q6('sum(m)')} AS matched_len_m FROM nr JOIN sm USING (sid) GROUP BY 1""")
def _(t):
    sh = F.transform("line", lambda v: G.point(v["x"] + 4, v["y"] + 3))
    census = I.lines(t).where("seg_id % 3 = 0").select(F.col("seg_id").alias("line_id"), sh.alias("line"), "value")
    d = spatial.line_apportion(census, I.lines(t), "value")
    return d.select("seg_id", r6("value").alias("value"), r6("matched_len_m").alias("matched_len_m"))


@query("target_counts", f"""WITH {PLC_SQL}, {LIN_SQL}, {BLD_SQL}, {near_sql('plc', 60)}, one AS (SELECT addr, min(id) AS id FROM plc GROUP BY 1),
   a AS (SELECT seg_id, count(*) AS addr_units, count(*) FILTER (id IN (SELECT id FROM one)) AS front_doors, sum(units) AS resunits, sum(units * 10) AS retail_sqft, sum((id % 2)::DOUBLE) AS garage_parcels FROM nr JOIN plc USING (id) GROUP BY 1),
   be AS (SELECT b, bldg_class, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM bld UNION ALL SELECT b, bldg_class, x1, y0, x1, y1 FROM bld UNION ALL SELECT b, bldg_class, x1, y1, x0, y1 FROM bld UNION ALL SELECT b, bldg_class, x0, y1, x0, y0 FROM bld),
   bd AS (SELECT b.b, b.bldg_class, a.seg_id, min(CASE WHEN a.x1 >= w.x0 AND a.x1 < w.x1 AND a.y1 >= w.y0 AND a.y1 < w.y1 THEN 0 ELSE {EE('a.', 'b.')} END) AS d FROM be b JOIN bld w ON w.b = b.b JOIN le a ON abs(a.x1 - b.x1) < 350 AND abs(a.y1 - b.y1) < 350 GROUP BY 1, 2, 3),
   bb AS (SELECT * FROM bd WHERE d <= 15 QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, seg_id) = 1), f AS (SELECT seg_id, count(*) AS bldg_front, count(*) FILTER (bldg_class = 'residential') AS bldg_front_resid FROM bb GROUP BY 1)
   , {near_sql('(SELECT id, px, py FROM plc WHERE id % 4 = 1)', 30, name='en')}, n AS (SELECT seg_id, count(*) AS osm_entrances FROM en GROUP BY 1)
   SELECT seg_id, coalesce(front_doors, 0) AS front_doors, coalesce(addr_units, 0) AS addr_units, coalesce(resunits, 0) AS resunits, coalesce(retail_sqft, 0) AS retail_sqft, coalesce(garage_parcels, 0) AS garage_parcels,
     coalesce(bldg_front, 0) AS bldg_front, coalesce(bldg_front_resid, 0) AS bldg_front_resid, coalesce(osm_entrances, 0) AS osm_entrances FROM a FULL JOIN f USING (seg_id) FULL JOIN n USING (seg_id)""")
def _(t):
    p = I.places(t)
    lots = p.withColumns({"retail": F.col("units") * 10, "garage": (F.col("id") % 2).cast("double")})
    houses = I.buildings(t).withColumn("bldg_class", F.initcap("bldg_class"))        # classes come in any case
    return spatial.target_counts(I.lines(t), p, lots, houses, entrances=p.where("id % 4 = 1")).drop("parcel_n")


DISK_SQL = f"""{LIN_SQL}, {SAMP_SQL.format(src='lin')}, sp AS (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, greatest(round_even((l1 + l2) / 20, 0), 1)::BIGINT AS n FROM ln)),
   sm AS (SELECT seg_id, (l1 + l2) / n AS w, {PX} AS px, {PY} AS py FROM sp), q AS (SELECT seg_id AS id, bx AS x, bq AS y FROM lin)"""


@query("line_length_in_disk", f"""WITH {DISK_SQL} SELECT id, {q6('sum(w)', 4)} AS len_m FROM q JOIN sm ON px BETWEEN x - 400 AND x + 400 AND py BETWEEN y - 400 AND y + 400 AND sqrt((px - x) ** 2 + (py - y) ** 2) <= 400 GROUP BY 1""")
def _(t):
    return spatial.line_length_in_disk(line_pts(t), I.lines(t), 400.0).select("id", r6("len_m", 4).alias("len_m"))


@query("walk_drive_ratio", f"""WITH {DISK_SQL}, s AS (SELECT id, sum(w) AS walk, coalesce(sum(w) FILTER (seg_id % 3 <> 0), 0) AS drive FROM q JOIN sm ON px BETWEEN x - 400 AND x + 400 AND py BETWEEN y - 400 AND y + 400
   AND sqrt((px - x) ** 2 + (py - y) ** 2) <= 400 GROUP BY 1) SELECT id, {q6('walk / nullif(drive, 0)')} AS walk_drive_ratio FROM s""")
def _(t):
    q, l = line_pts(t), I.lines(t)
    d = spatial.line_length_in_disk(spatial.line_length_in_disk(q, l, 400.0, out="walk"), l.where("seg_id % 3 != 0"), 400.0, out="drive")
    return d.select("id", r6(F.col("walk") / F.when(F.col("drive") != 0, F.col("drive"))).alias("walk_drive_ratio"))


RX, RY = AT("(i / (n - 1.0) * (l1 + l2))")


@query("segment_mean_of_samples", f"""WITH {PIX_SQL}, p AS (SELECT raster_id, row, col, z FROM px), {LIN_SQL}, {SAMP_SQL.format(src='lin')},
   sp AS (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, greatest(round_even((l1 + l2) / 20, 0) + 1, 2)::BIGINT AS n FROM ln)),
   sm AS (SELECT seg_id, floor(({RX}) / 100)::INT AS col, floor((6000 - ({RY})) / 100)::INT AS row FROM sp), m AS (SELECT seg_id, raster_id, avg(z) AS z FROM sm JOIN p USING (row, col) GROUP BY 1, 2)
   SELECT seg_id, raster_id, {q6('z')} AS z FROM lin LEFT JOIN m USING (seg_id)""")
def _(t):
    d = spatial.segment_mean_of_samples(I.lines(t), I.pixels(t), 0.0, 6000.0, 100.0)
    return d.select("seg_id", "raster_id", r6("z").alias("z"))


# ---- dependence -------------------------------------------------------------------------
KNN_SQL = f"""{PTS_SQL}, kd AS (SELECT a.id AS i, b.id AS j, a.grp AS gi, b.grp AS gj, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pts a JOIN pts b ON a.id <> b.id),
   kn AS (SELECT i, j, gi, gj FROM kd QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 8)"""


@query("knn_weights", f"WITH {KNN_SQL} SELECT i, j, 0.125::DOUBLE AS w FROM kn")
def _(t):
    return dependence.knn_weights(I.points(t), 8)


@query("cross_group_weights", f"""WITH RECURSIVE {KNN_SQL}, c AS (SELECT i, j FROM kn WHERE gi <> gj), {', '.join(
    f"c{n} AS MATERIALIZED (SELECT * FROM {'c' if n == 0 else f'c{n-1}'} WHERE j IN (SELECT i FROM {'c' if n == 0 else f'c{n-1}'}))" for n in range(8))}
   SELECT i, j, {q6('1.0::DOUBLE / count(*) OVER (PARTITION BY i)')} AS w FROM c7""")
def _(t):
    return dependence.cross_group_weights(I.points(t), 8, "grp").withColumn("w", r6("w"))


@query("morans_i", f"""WITH {KNN_SQL}, z AS (SELECT id, x - avg(x) OVER () AS z FROM pts), s AS (SELECT sum(z * z) AS zz, count(*) AS n FROM z),
   k AS (SELECT sum(0.125 * a.z * b.z) AS num FROM kn JOIN z a ON a.id = i JOIN z b ON b.id = j)
   SELECT {q6('num / zz', 8)} AS morans_i, {q6('-1.0::DOUBLE / (n - 1)', 8)} AS expected_i, n AS n_units FROM k, s""")
def _(t):
    p = I.points(t)
    m = dependence.morans_i(p.select("id", F.col("x").alias("e")), dependence.knn_weights(p, 8), permutations=0)
    return m.select(r6("morans_i", 8).alias("morans_i"), r6("expected_i", 8).alias("expected_i"), "n_units")


@query("morans_i_permutation", f"""WITH RECURSIVE {KNN_SQL}, z AS (SELECT id, x - avg(x) OVER () AS z, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM pts),
   b AS (SELECT *, greatest(2, ceil(log2(n))::BIGINT) AS bits FROM z), h AS (SELECT *, bits - bits // 2 AS hi, bits // 2 AS lo FROM b), reps AS (SELECT unnest(range(999)) AS rep),
   wk AS (SELECT pos, rep, n, hi, lo, {permuted_sql('pos', 'rep', 1)} AS v FROM h, reps UNION ALL SELECT pos, rep, n, hi, lo, {permuted_sql('v', 'rep', 1)} FROM wk WHERE v >= n),
   zz AS MATERIALIZED (SELECT w.pos, w.rep, z.z FROM wk w JOIN z ON z.pos = w.v WHERE w.v < w.n), e AS MATERIALIZED (SELECT a.pos AS pi, c.pos AS pj FROM kn JOIN z a ON a.id = i JOIN z c ON c.id = j),
   s AS (SELECT sum(z * z) AS zz, count(*) AS n FROM z), k AS (SELECT sum(0.125 * a.z * c.z) AS num, count(*) * 0.125 AS s0 FROM e JOIN z a ON a.pos = pi JOIN z c ON c.pos = pj),
   sim AS (SELECT a.rep, sum(0.125 * a.z * c.z) AS num FROM e JOIN zz a ON a.pos = pi JOIN zz c ON c.pos = pj AND c.rep = a.rep GROUP BY 1),
   c AS (SELECT count(*) FILTER (sim.num >= k.num) AS c FROM sim, k), bw AS (SELECT pi, pj FROM e UNION ALL SELECT pj, pi FROM e),
   s1 AS (SELECT sum(ws * ws) / 2 AS s1 FROM (SELECT count(*) * 0.125 AS ws FROM bw GROUP BY pi, pj)), s2 AS (SELECT sum(r * r) AS s2 FROM (SELECT count(*) * 0.125 AS r FROM bw GROUP BY pi)),
   v AS (SELECT *, n / s0 * num / zz AS i, -1.0::DOUBLE / (n - 1) AS ei, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1.0::DOUBLE) * s0 * s0) - (1.0::DOUBLE / (n - 1)) ** 2 AS var FROM s, k, s1, s2)
   SELECT {q6('i', 8)} AS morans_i, {q6('ei', 8)} AS expected_i, n AS n_units, {q6('(i - ei) / sqrt(var)')} AS z_norm, {q6('(least(c, 999 - c) + 1) / 1000.0')} AS p_sim FROM v, c""")
def _(t):
    p = ordered_index(I.points(t), [], "id", "pos")
    m = dependence.morans_i(p.select("id", F.col("x").alias("e"), "pos"), dependence.knn_weights(p, 8), permutations=999)
    return m.select(r6("morans_i", 8).alias("morans_i"), r6("expected_i", 8).alias("expected_i"), "n_units", r6("z_norm").alias("z_norm"), r6("p_sim").alias("p_sim"))


@query("conley_se", f"""WITH {ONE_SQL}, e AS (SELECT city, cell, "GEOID" AS g, x, y AS yy, n_returned AS n, slope_deg AS s, exp(b * slope_deg) * {OFF} AS e FROM panel JOIN nfit ON k = city),
   m AS (SELECT *, e * sum(n) OVER w / sum(e) OVER w AS mu, sum(e * s) OVER w / sum(e) OVER w AS sb FROM e WINDOW w AS (PARTITION BY city, g)), sc AS (SELECT city, cell, x, yy, mu * (s - sb) ** 2 AS h, (n - mu) * (s - sb) AS sc FROM m),
   h AS (SELECT city, sum(h) AS h FROM sc GROUP BY 1), p AS (SELECT a.city, sum(a.sc * b.sc * greatest(0, 1 - sqrt((a.x - b.x) ** 2 + (a.yy - b.yy) ** 2) / 450)) AS v FROM sc a JOIN sc b ON a.city = b.city AND abs(a.x - b.x) <= 450 AND abs(a.yy - b.yy) <= 450 GROUP BY 1)
   SELECT city, {q6('CASE WHEN v > 0 THEN sqrt(v) / h END', 7)} AS conley_se FROM p JOIN h USING (city)""")
def _(t):
    d = I.panel(t)
    fit = ppml.ppml_fe(d, [ONE], ["city"])
    c = dependence.conley_se(d, ONE, fit, ["city"], 450.0)
    return c.select("city", r6(F.get("conley", F.lit(0)), 7).alias("conley_se"))


@query("moran_eigenvectors")
def _(t):
    values, vectors = dependence.moran_eigenvectors(I.points(t).select("id", "x", "y"), dependence.knn_weights(I.points(t), 8), k=20)
    size = vectors.select(F.posexplode("v").alias("vec", "v")).groupBy("vec").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    return values.join(size, "vec")


@query("moran_selected")
def _(t):
    p = I.points(t)
    values, vectors = dependence.moran_eigenvectors(p.select("id", "x", "y"), dependence.knn_weights(p, 8), k=20)
    long = p.select("id", "grp", F.col("x").alias("resid")).join(vectors.select("id", F.posexplode("v").alias("vec", "val")), "id")
    return dependence.select_eigenvectors(long, values, "grp", most=2)


@query("select_eigenvectors", f"""WITH {PTS_SQL}, v AS (SELECT id, grp, x AS resid, unnest([0, 1, 2]) AS vec, unnest([sin(id / 10.0), cos(id / 25.0), y]) AS val FROM pts),
   d AS (SELECT vec, val - avg(val) OVER (PARTITION BY vec, grp) AS v, resid - avg(resid) OVER (PARTITION BY vec, grp) AS r FROM v)
   SELECT vec::INT AS vec, {q6('abs(avg(v * r) / (stddev_pop(v) * stddev_pop(r) + 1e-30))')} AS score FROM d GROUP BY 1 ORDER BY score DESC LIMIT 2""")
def _(t):
    arms = F.array(*[F.struct(F.lit(i).alias("vec"), v.alias("val")) for i, v in enumerate((F.sin(F.col("id") / 10.0), F.cos(F.col("id") / 25.0), F.col("y")))])
    v = I.points(t).select("id", "grp", F.col("x").alias("resid"), F.explode(arms).alias("_v")).select("id", "grp", "resid", "_v.*")
    values = t.spark.createDataFrame([(0, 1.0), (1, 0.6), (2, 0.3)], "vec int, lam double")
    return dependence.select_eigenvectors(v, values, "grp", most=2).select("vec", r6("score").alias("score"))


TAGS = ["house", "Retail", "garage", "yes", "Apartments", "school", "warehouse", "pond"]


@query("osm_use_class", f"""WITH g AS (SELECT p_partkey AS b, CASE WHEN p_partkey % 13 <> 0 THEN ({I.sql_list(TAGS)})[(p_partkey % {len(TAGS)} + 1)::INT] END AS tag, p_size % 5 = 0 OR p_size % 7 = 0 AS biz FROM part)
   SELECT b, CASE WHEN tag IN ('Retail', 'warehouse') THEN 'commercial' WHEN tag IN ('house', 'Apartments') THEN 'residential' WHEN biz THEN 'commercial' WHEN tag IN ('garage', 'school') THEN 'other' ELSE 'unknown' END AS use FROM g""")
def _(t):
    from panelwright.functions.buildings import osm_use_class
    k = F.col("p_partkey")
    tag = F.when(k % 13 != 0, F.element_at(F.array(*[F.lit(v) for v in TAGS]), (k % len(TAGS) + 1).cast("int")))
    shop, office = F.when(F.col("p_size") % 5 == 0, "x"), F.when(F.col("p_size") % 7 == 0, "y")
    return t.part.select(k.alias("b"), osm_use_class(tag, shop, office).alias("use"))
