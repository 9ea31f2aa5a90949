"""Panels, feeds, rasters, networks and layers derived from the driver's tables.

Every frame is computed by Spark from a whole table, so its size follows that
table.  The ``*_SQL`` strings are the same formulas for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import geometry as G

# A short offence vocabulary; a description is picked by event number.
OFFENCES = [
    "THEFT F/AUTO", "AUTO, STOLEN", "VEHICLE - STOLEN", "BURGLARY FROM VEHICLE",
    "Theft of Motor Vehicle Parts or Accessories", "CRIMINAL DAMAGING/ENDANGERING",
    "Pocket-picking", "Identity Theft", "FIRE (NOT ARSON)", "BICYCLE INFRACTION (COMMERCIAL)",
    "theft-items-from-vehicle theft-from-motor-vehicle", "robbery-purse-snatch-w-force robbery",
    "B & E, COMMERCIAL", "Motor Vehicle Theft", "graffiti|other", "Burglary - Residential",
    "SHOPLIFTING", "Larceny Theft - Bicycle", "bicycle theft", "noise complaint",
    "larceny of motor vehicle license plate", "embezzlement", "stolen vehicle recovered",
]
SUBCATS = ["Larceny Theft - Pickpocket", "Theft From Vehicle", "Larceny Theft - Other",
           "Burglary - Residential", "Larceny - Auto Parts", "Motor Vehicle Theft", "Vandalism",
           "Robbery - Street", "Burglary - Commercial", "Burglary - Hot Prowl", "Fraud"]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- incidents from events ---------------------------------------------------
def incidents(t) -> DataFrame:
    """Dated, described points: sentinels, nulls and an outlier are mixed in by event number."""
    k = F.col("event_id")
    lat = (F.when(k % 97 == 0, F.lit(0.0)).when(k % 89 == 0, F.lit(-1.0))
            .when(k % 101 == 0, F.lit(None).cast("double"))
            .otherwise(37.75 + ((k * 7919) % 1999 - 999) / 20000.0))
    lon = (F.when(k % 97 == 0, F.lit(0.0))
            .when(k % 103 == 0, F.lit(-100.0))
            .otherwise(-122.4 + ((k * 104729) % 2003 - 1001) / 20000.0))
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]),
                                     ((k * 31 + F.col("user_id")) % len(vals) + 1).cast("int"))
    return t.events.select(
        k, F.concat(F.lit("feed_"), F.col("user_id") % 7).alias("feed"),
        lat.alias("lat"), lon.alias("lon"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.when(k % 53 != 0, pick(OFFENCES)).alias("desc1"), pick(SUBCATS).alias("subcat"))


INC_SQL = f"""inc AS (
  SELECT event_id, 'feed_' || (user_id % 7) AS feed,
    CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE WHEN event_id % 89 = 0 THEN -1.0::DOUBLE
         WHEN event_id % 101 = 0 THEN NULL
         ELSE 37.75::DOUBLE + ((event_id * 7919) % 1999 - 999)::DOUBLE / 20000.0::DOUBLE END AS lat,
    CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE WHEN event_id % 103 = 0 THEN -100.0::DOUBLE
         ELSE -122.4::DOUBLE + ((event_id * 104729) % 2003 - 1001)::DOUBLE / 20000.0::DOUBLE END AS lon,
    ts, user_id, event_type, value,
    CASE WHEN event_id % 53 <> 0 THEN ({sql_list(OFFENCES)})[((event_id * 31 + user_id) % {len(OFFENCES)} + 1)::INT] END AS desc1,
    ({sql_list(SUBCATS)})[((event_id * 31 + user_id) % {len(SUBCATS)} + 1)::INT] AS subcat
  FROM events)"""


# ---- cell panel from lineitem and supplier ------------------------------------
def panel(t) -> DataFrame:
    """100 m cells: (supplier, part mod 20) units inside supplier groups inside 5 cities."""
    cell = F.col("l_suppkey") * 20 + F.col("l_partkey") % 20
    names = {1: "n_MASS_1", 2: "n_MASS_2", 3: "n_MASS_3", 4: "n_MASS_4", 5: "n_MASS_5",
             6: "n_MVT", 7: "n_NO_LOOT"}
    q, qi = F.col("l_quantity"), F.col("l_quantity").cast("bigint")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    units = t.lineitem.groupBy(cell.alias("cell"), F.col("l_suppkey").alias("GEOID")).agg(
        *[F.count_if(F.col("l_linenumber") == i).alias(n) for i, n in names.items()],
        F.count("*").alias("n_total"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        (F.sum(cents("l_discount")) / F.count("*")).alias("slope_deg"),
        ((F.sum(cents("l_tax")) / F.count("*") - 4.0) * 2.0).alias("tpi_500"),
        (F.sum(qi) / F.count("*")).alias("elev"),
        (F.sum(qi) / 10.0).alias("housing_units_cell"), (F.sum(qi) / 4.0).alias("pop_cell"),
        (F.sum(qi * cents("l_discount")) / 50.0).alias("housing_units_bldg"),
        (F.sum(qi * cents("l_tax")) / 20.0).alias("pop_bldg"))
    s = t.supplier.select(
        F.col("s_suppkey").alias("GEOID"), "s_nationkey",
        F.when(F.col("s_suppkey") % 17 != 0, F.col("s_acctbal") * 10).alias("median_hh_income"),
        (40000.0 + (F.col("s_suppkey") * 7919) % 1000 * 300).alias("median_home_value"))
    return units.join(s, "GEOID").withColumns({
        "city": F.concat(F.lit("city_"), F.col("GEOID") % 5),
        "x": (F.col("cell") % 20) * 100.0 + 50.0, "y": F.col("GEOID") * 100.0 + 50.0,
        "owner_share": ((F.col("cell") * 7) % 50) / 50.0,
        "vacancy_rate": ((F.col("cell") * 11) % 30) / 100.0,
        "ALAND": F.when(F.col("GEOID") % 13 != 0, 20000.0 + F.col("GEOID") * 10),
        "land_frac": 0.5 + (F.col("cell") % 6) / 10.0,
        "seg_len_m": 12.0 + F.col("cell") % 90,
    })


PANEL_SQL = """u AS (
  SELECT l_suppkey * 20 + l_partkey % 20 AS cell, l_suppkey AS "GEOID",
    count(*) FILTER (l_linenumber = 1) AS "n_MASS_1", count(*) FILTER (l_linenumber = 2) AS "n_MASS_2",
    count(*) FILTER (l_linenumber = 3) AS "n_MASS_3", count(*) FILTER (l_linenumber = 4) AS "n_MASS_4",
    count(*) FILTER (l_linenumber = 5) AS "n_MASS_5", count(*) FILTER (l_linenumber = 6) AS "n_MVT",
    count(*) FILTER (l_linenumber = 7) AS "n_NO_LOOT", count(*) AS n_total,
    count(*) FILTER (l_returnflag = 'R') AS n_returned,
    sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS slope_deg,
    (sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) - 4.0) * 2.0 AS tpi_500,
    sum(l_quantity::BIGINT)::DOUBLE / count(*) AS elev,
    sum(l_quantity::BIGINT)::DOUBLE / 10.0 AS housing_units_cell,
    sum(l_quantity::BIGINT)::DOUBLE / 4.0 AS pop_cell,
    sum(l_quantity::BIGINT * round(l_discount * 100)::BIGINT)::DOUBLE / 50.0 AS housing_units_bldg,
    sum(l_quantity::BIGINT * round(l_tax * 100)::BIGINT)::DOUBLE / 20.0 AS pop_bldg
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT u.*, s_nationkey, CASE WHEN s_suppkey % 17 <> 0 THEN s_acctbal * 10 END AS median_hh_income,
    40000.0::DOUBLE + (s_suppkey * 7919) % 1000 * 300 AS median_home_value, 'city_' || ("GEOID" % 5) AS city,
    (cell % 20) * 100.0::DOUBLE + 50.0 AS x, "GEOID" * 100.0::DOUBLE + 50.0 AS y,
    ((cell * 7) % 50)::DOUBLE / 50.0 AS owner_share, ((cell * 11) % 30)::DOUBLE / 100.0 AS vacancy_rate,
    CASE WHEN "GEOID" % 13 <> 0 THEN 20000.0::DOUBLE + "GEOID" * 10 END AS "ALAND",
    0.5::DOUBLE + (cell % 6)::DOUBLE / 10.0 AS land_frac, 12.0::DOUBLE + cell % 90 AS seg_len_m
  FROM u JOIN supplier ON s_suppkey = "GEOID")"""


# ---- planar points from embeddings --------------------------------------------
def points(t) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("grp"),
                               (e[0].cast("double") * 1000).alias("x"),
                               (e[1].cast("double") * 1000).alias("y"))


PTS_SQL = """pts AS (SELECT vec_id AS id, label::INT AS grp, embedding[1]::DOUBLE * 1000 AS x,
  embedding[2]::DOUBLE * 1000 AS y FROM embeddings)"""

# ---- rasters from orders: 60 x 60 pixel blocks, one raster per 3600 orders ------
SIDE = 60


def pixels(t) -> DataFrame:
    k = F.col("o_orderkey")
    row = F.floor((k % (SIDE * SIDE)) / SIDE).cast("int")
    col = (k % SIDE).cast("int")
    cents = F.round(F.col("o_totalprice")).cast("bigint")
    z = (row * 7 + col * 13) % 50 + row * 0.5 + (cents % 16) / 4.0
    return t.orders.select(F.floor(k / (SIDE * SIDE)).cast("int").alias("raster_id"),
                           row.alias("row"), col.alias("col"),
                           F.when((row * 31 + col * 17) % 97 != 0, z.cast("double")).alias("z"))


PIX_SQL = """px AS (SELECT (o_orderkey // 3600)::INT AS raster_id, ((o_orderkey % 3600) // 60)::INT AS row,
  (o_orderkey % 60)::INT AS col,
  CASE WHEN (((o_orderkey % 3600) // 60) * 31 + (o_orderkey % 60) * 17) % 97 <> 0 THEN
    ((((o_orderkey % 3600) // 60) * 7 + (o_orderkey % 60) * 13) % 50)::DOUBLE
     + ((o_orderkey % 3600) // 60) * 0.5::DOUBLE + (round(o_totalprice)::BIGINT % 16)::DOUBLE / 4.0 END AS z
  FROM orders)"""

# ---- street network from customers: a lattice per nation -----------------------
WIDE = 8


def streets(t) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed edges.  Customers of one nation form one lattice, in key order."""
    c = t.customer
    seat = F.floor(F.col("c_custkey") / 25).cast("bigint")
    net = (F.col("c_custkey") % 25).cast("int")
    n = c.select(net.alias("net"), seat.alias("node"), F.round(F.abs("c_acctbal")).cast("bigint").alias("a"))
    nodes = n.select("net", "node", ((F.col("node") % WIDE) * 100.0).alias("x"),
                     (F.floor(F.col("node") / WIDE) * 100.0).alias("y"))
    arms = F.array(F.struct(F.when(F.col("node") % WIDE != WIDE - 1, F.col("node") + 1).alias("v"), F.lit(0).alias("s")),
                   F.struct((F.col("node") + WIDE).alias("v"), F.lit(1).alias("s")))
    e = n.select("net", F.col("node").alias("u"), "a", F.explode(arms).alias("_a")).select(
        "net", "u", F.col("_a.v").alias("v"), "a", F.col("_a.s").alias("s"))
    e = e.where("v is not null and (u * 7 + v) % 5 != 0 and (a + s) % 4 != 0")
    e = e.join(nodes.select("net", F.col("node").alias("v")), ["net", "v"], "left_semi")
    length = (50 + (F.col("a") + F.col("u") + F.col("v")) % 40).cast("double")
    fwd = e.select("net", F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("key"),
                   length.alias("length"), (length / (5 + F.col("a") % 3)).alias("travel_time"))
    back = fwd.where("(src + dst) % 6 != 0").select(
        "net", F.col("dst").alias("src"), F.col("src").alias("dst"), "key", "length", "travel_time")
    return nodes, fwd.unionByName(back)


NET_SQL = """nn AS (SELECT (c_custkey % 25)::INT AS net, c_custkey // 25 AS node,
    round(abs(c_acctbal))::BIGINT AS a FROM customer),
nodes AS (SELECT net, node, (node % 8) * 100.0::DOUBLE AS x, (node // 8) * 100.0::DOUBLE AS y FROM nn),
e0 AS (SELECT net, node AS u, node + 1 AS v, a, 0 AS s FROM nn WHERE node % 8 <> 7
       UNION ALL SELECT net, node, node + 8, a, 1 FROM nn),
e1 AS (SELECT e0.* FROM e0 SEMI JOIN nodes ON e0.net = nodes.net AND e0.v = nodes.node
       WHERE (u * 7 + v) % 5 <> 0 AND (a + s) % 4 <> 0),
fwd AS (SELECT net, u AS src, v AS dst, 0 AS key, (50 + (a + u + v) % 40)::DOUBLE AS length,
         (50 + (a + u + v) % 40)::DOUBLE / (5 + a % 3) AS travel_time FROM e1),
edges AS (SELECT * FROM fwd UNION ALL SELECT net, dst, src, key, length, travel_time FROM fwd
          WHERE (src + dst) % 6 <> 0)"""

# ---- layers: buildings from part, zones from supplier, lines from customer -------


def buildings(t) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x0 = (k % 50) * 120.0 + (k * 37) % 60
    y0 = F.floor(k / 50) * 120.0 + (k * 53) % 60
    w, h = 6.0 + s * 2, 5.0 + (s * 7) % 60
    tag = F.element_at(F.array(*[F.lit(v) for v in ["residential", "commercial", "other", "unknown"]]),
                       (k % 4 + 1).cast("int"))
    return t.part.select(k.alias("b"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"),
                         (y0 + h).alias("y1"), (w * h).alias("area_m2"), tag.alias("bldg_class"),
                         G.rect_ring(x0, y0, x0 + w, y0 + h).alias("ring"))


BLD_SQL = """bld AS (SELECT p_partkey AS b, (p_partkey % 50) * 120.0::DOUBLE + (p_partkey * 37) % 60 AS x0,
    (p_partkey // 50) * 120.0::DOUBLE + (p_partkey * 53) % 60 AS y0,
    (p_partkey % 50) * 120.0::DOUBLE + (p_partkey * 37) % 60 + (6.0::DOUBLE + p_size * 2) AS x1,
    (p_partkey // 50) * 120.0::DOUBLE + (p_partkey * 53) % 60 + (5.0::DOUBLE + (p_size * 7) % 60) AS y1,
    (6.0::DOUBLE + p_size * 2) * (5.0::DOUBLE + (p_size * 7) % 60) AS area_m2,
    (['residential','commercial','other','unknown'])[(p_partkey % 4 + 1)::INT] AS bldg_class FROM part)"""


def zones(t) -> DataFrame:
    """300 m squares, every seventh an L (its upper right quarter cut away)."""
    k = F.col("s_suppkey")
    x0, y0 = (k % 20) * 300.0, F.floor(k / 20) * 300.0
    sq = G.rect_ring(x0, y0, x0 + 300, y0 + 300)
    ell = F.array(G.point(x0, y0), G.point(x0 + 300, y0), G.point(x0 + 300, y0 + 150),
                  G.point(x0 + 150, y0 + 150), G.point(x0 + 150, y0 + 300), G.point(x0, y0 + 300))
    return t.supplier.select(k.alias("zone"), F.when(k % 7 == 0, ell).otherwise(sq).alias("ring"),
                             (100 + k % 50).cast("double").alias("housing_units"),
                             (250 + k % 90).cast("double").alias("population"))


ZON_SQL = """zon AS (SELECT s_suppkey AS zone, (s_suppkey % 20) * 300.0::DOUBLE AS zx,
    (s_suppkey // 20) * 300.0::DOUBLE AS zy, s_suppkey % 7 = 0 AS ell, (100 + s_suppkey % 50)::DOUBLE AS housing_units,
    (250 + s_suppkey % 90)::DOUBLE AS population FROM supplier)"""
IN_ZONE_SQL = """(px >= zx AND px < zx + 300 AND py >= zy AND py < zy + 300
    AND NOT (ell AND px >= zx + 150 AND py >= zy + 150))"""


def areas(t) -> DataFrame:
    """Areas as parts: squares, squares with a hole, pairs of strips, and area -1 over all of them, with a hole."""
    k = F.col("s_suppkey")
    x0, y0 = (k % 20) * 300.0, F.floor(k / 20) * 300.0
    box = lambda a, b, c, d: G.rect_ring(x0 + a, y0 + b, x0 + c, y0 + d)
    none = F.slice(F.array(box(0, 0, 1, 1)), 1, 0)
    part = lambda ring, *holes: F.struct(ring.alias("ring"), (F.array(*holes) if holes else none).alias("holes"))
    parts = (F.when(k % 3 == 0, F.array(part(box(0, 0, 300, 300), box(100, 100, 200, 200))))
             .when(k % 3 == 1, F.array(part(box(0, 0, 100, 300)), part(box(200, 0, 300, 300)))).otherwise(F.array(part(box(0, 0, 300, 300)))))
    tag = F.element_at(F.array(*[F.lit(v) for v in ["residential", "commercial", "other", "unknown"]]), (k % 4 + 1).cast("int"))
    d = t.supplier.select(k.alias("zone"), parts.alias("parts"), tag.alias("tag"))
    far = lambda a, b, c, d: G.rect_ring(*[F.lit(v) for v in (a, b, c, d)])
    # as many rows as the smallest key has, which is one
    over = t.supplier.where(k == 1).select(F.lit(-1).cast("bigint").alias("zone"), F.array(F.struct(
        far(-50.0, -50.0, 6050.0, 6050.0).alias("ring"), F.array(far(40.0, 700.0, 2150.0, 1250.0)).alias("holes"))).alias("parts"), F.lit("other").alias("tag"))
    return d.unionByName(over)


#: Rectangles that areas are made of, with sign 1 or -1 (holes).
ARE_SQL = """abox AS (SELECT s_suppkey AS zone, (s_suppkey % 20) * 300.0::DOUBLE AS ax, (s_suppkey // 20) * 300.0::DOUBLE AS ay FROM supplier),
arect AS (SELECT zone, ax AS x0, ay AS y0, CASE WHEN zone % 3 = 1 THEN ax + 100 ELSE ax + 300 END AS x1, ay + 300 AS y1, 1 AS sign FROM abox
  UNION ALL SELECT zone, ax + 200, ay, ax + 300, ay + 300, 1 FROM abox WHERE zone % 3 = 1
  UNION ALL SELECT zone, ax + 100, ay + 100, ax + 200, ay + 200, -1 FROM abox WHERE zone % 3 = 0
  UNION ALL SELECT -1, -50, -50, 6050, 6050, 1 FROM abox WHERE zone = 1 UNION ALL SELECT -1, 40, 700, 2150, 1250, -1 FROM abox WHERE zone = 1),
atag AS (SELECT zone, (['residential','commercial','other','unknown'])[(zone % 4 + 1)::INT] AS tag FROM abox UNION ALL SELECT -1, 'other')"""


def lines(t) -> DataFrame:
    """Street lines of two edges from a customer's seat on a 60-wide grid."""
    k = F.col("c_custkey")
    a = F.round(F.abs("c_acctbal")).cast("bigint")
    x0, y0 = (k % 60) * 100.0 + a % 30, F.floor(k / 60) * 100.0 + a % 20
    mid = (x0 + 60.0 + a % 25, y0 + 10.0)
    end = (x0 + 70.0 + a % 25, y0 + 60.0 + a % 45)
    return t.customer.select(k.alias("seg_id"), F.array(G.point(x0, y0), G.point(*mid), G.point(*end)).alias("line"),
                             (1 + a % 9).cast("double").alias("value"))


LIN_SQL = """lin AS (SELECT c_custkey AS seg_id, (c_custkey % 60) * 100.0::DOUBLE + a % 30 AS ax,
    (c_custkey // 60) * 100.0::DOUBLE + a % 20 AS ay,
    (c_custkey % 60) * 100.0::DOUBLE + a % 30 + 60.0 + a % 25 AS bx,
    (c_custkey // 60) * 100.0::DOUBLE + a % 20 + 10.0 AS bq,
    (c_custkey % 60) * 100.0::DOUBLE + a % 30 + 70.0 + a % 25 AS cx,
    (c_custkey // 60) * 100.0::DOUBLE + a % 20 + 60.0 + a % 45 AS cy, (1 + a % 9)::DOUBLE AS value
  FROM (SELECT c_custkey, round(abs(c_acctbal))::BIGINT AS a FROM customer)),
le AS (SELECT seg_id, 1 AS k, ax AS x1, ay AS y1, bx AS x2, bq AS y2 FROM lin
       UNION ALL SELECT seg_id, 2, bx, bq, cx, cy FROM lin)"""


def places(t) -> DataFrame:
    """Points over the lines' area from orders (snapping, counting, apportioning)."""
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), F.col("o_custkey").alias("addr"),
                           ((k * 131) % 6000).cast("double").alias("px"),
                           (F.floor(k / 600) * 100.0 + (k * 17) % 100).cast("double").alias("py"),
                           (1 + k % 5).cast("double").alias("units"))


PLC_SQL = """plc AS (SELECT o_orderkey AS id, o_custkey AS addr, ((o_orderkey * 131) % 6000)::DOUBLE AS px,
    (o_orderkey // 600) * 100.0::DOUBLE + (o_orderkey * 17) % 100 AS py, (1 + o_orderkey % 5)::DOUBLE AS units FROM orders)"""


# ---- study estimates per nation ---------------------------------------------------
def studies(t) -> DataFrame:
    """One effect and standard error per nation: mean discount points of its suppliers' lines."""
    d = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    y = F.round(F.col("l_discount") * 100).cast("bigint")
    g = d.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"))
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    k = F.col("s_nationkey")
    return (g.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
             .select(F.col("n_name").alias("study"), F.col("n_regionkey").cast("int").alias("pool"), k.cast("int").alias("k"),
                     ((mean - 5.0) / 10.0 + (k % 4) * 0.01).alias("beta"), (F.sqrt(var / F.col("n")) / 10.0).alias("se"),
                     ((k * 7) % 11).cast("double").alias("xmod"), F.col("n").alias("events")))


STU_SQL = """stu AS (SELECT n_name AS study, n_regionkey::INT AS pool, s_nationkey::INT AS k,
    (s1::DOUBLE / n - 5.0) / 10.0 + (s_nationkey % 4) * 0.01::DOUBLE AS beta,
    sqrt(((s2 - s1::DOUBLE * s1 / n) / (n - 1)) / n) / 10.0 AS se, ((s_nationkey * 7) % 11)::DOUBLE AS xmod, n AS events
  FROM (SELECT s_nationkey, count(*) AS n, sum(round(l_discount * 100)::BIGINT)::BIGINT AS s1,
          sum(round(l_discount * 100)::BIGINT * round(l_discount * 100)::BIGINT)::BIGINT AS s2
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) JOIN nation ON n_nationkey = s_nationkey)"""


def r6(c, digits: int = 6):
    """Rounded double column for comparing with the SQL twin."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"
