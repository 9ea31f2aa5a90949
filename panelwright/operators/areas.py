"""Areas of several parts with holes: covers by grid cells, points in areas, overlays, interior points.

An area is ``parts``, an array of (ring, holes) as the readers give it; a simple ring is an area of
one part.  Inside and outside follow the even-odd rule over all rings, half-open like ``geometry.in_ring``.

A *cover* never copies an area into the cells it touches.  Each edge goes to the cells that
it passes; of a border cell only its own edges and one number are kept, the parity at its
lower left corner.  From there to any point of the cell lead a step up along the left side
and a step to the right, and only the cell's own edges can be crossed on the way.  The
cells between two border cells of a row are all inside or all outside; inside ones are
kept as dyadic blocks, some 2 log2(n) for n cells.  So an area takes rows by the length of its
outline, whatever its size, and no task holds more of it than a batch of edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import geometry as G
from panelwright.operators.spatial import salted_join
from panelwright.session import cut

SLACK = 1e-9                    # of a cell: how far an edge's cells reach beyond it, against rounding


def as_parts(df: DataFrame, shape: str) -> DataFrame:
    """``shape`` as parts, if it is a simple ring."""
    if "struct<ring" in dict(df.dtypes)[shape]:
        return df
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return df.withColumn(shape, F.when(F.col(shape).isNotNull(), F.array(F.struct(F.col(shape).alias("ring"), none.alias("holes")))))


def rings(parts: Column) -> Column:
    """All rings of three vertices or more as array<struct<ring, role>>, role 1 for outer rings and -1 for holes."""
    one = lambda r, role: F.struct(r.alias("ring"), F.lit(role).alias("role"))
    found = F.flatten(F.transform(parts, lambda p: F.concat(F.array(one(p["ring"], 1.0)), F.transform(p["holes"], lambda h: one(h, -1.0)))))
    return F.filter(found, lambda r: F.size(r["ring"]) >= 3)


def _twice(ring: Column) -> Column:
    """Twice the signed area; coordinates are taken from the first vertex, which keeps digits."""
    o = F.element_at(ring, 1)
    return F.aggregate(G.edges(G.close_ring(ring)), F.lit(0.0), lambda a, e: a + (
        (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"])))


def area(parts: Column) -> Column:
    return F.aggregate(rings(parts), F.lit(0.0), lambda a, r: a + r["role"] * F.abs(_twice(r["ring"])) / 2.0)


def area_edges(areas: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, x1, y1, x2, y2, turn) of all rings; turn is 1 where the edge has the inside on its left, else -1."""
    # dealt out first: a file of few bytes is read in one task, however many edges its areas have
    d = areas.select(key, shape).repartition(key).select(key, F.explode(rings(F.col(shape))).alias("_r"))
    d = G.pin(d, _t=F.signum(_twice(F.col("_r.ring"))) * F.col("_r.role"))
    e = d.select(key, F.explode(G.edges(G.close_ring(F.col("_r.ring")))).alias("_e"), F.col("_t").alias("turn"))
    return e.select(key, "_e.*", "turn")


# ---- covers ----------------------------------------------------------------------
def _crossing_x(y: Column) -> Column:
    """Where an edge meets a height; null for level edges."""
    return F.col("x1") + F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1"))


def _crossing_y(x: Column) -> Column:
    return F.col("y1") + F.try_divide((F.col("y2") - F.col("y1")) * (x - F.col("x1")), F.col("x2") - F.col("x1"))


def cover(areas: DataFrame, key: str, shape: str, size: float, ox: float = 0.0, oy: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Border edges (key, _bx, _by, edge, turn), border cells (key, _bx, _by, base) and inside blocks (key, _by, _level, _bx).

    Cell (i, j) is [ox + i size, ox + (i + 1) size) by the same in y.  base is 0 or 1: the parity just above and right of its
    lower left corner.  A block of level l stands for 2^l cells of a row.
    """
    s, slack = float(size), SLACK * size
    e = area_edges(areas, key, shape)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("_by", F.explode(F.sequence(F.floor((low - oy - slack) / s), F.floor((high - oy + slack) / s))))
    bottom = oy + F.col("_by") * s
    at = lambda y: _crossing_x(F.least(F.greatest(y, low), high))
    level = F.col("y1") == F.col("y2")
    a, b = F.when(level, F.col("x1")).otherwise(at(bottom)), F.when(level, F.col("x2")).otherwise(at(bottom + s))
    crossed = (F.col("y1") > bottom) != (F.col("y2") > bottom)
    e = e.withColumns({"_a": F.floor((F.least(a, b) - ox - slack) / s), "_z": F.floor((F.greatest(a, b) - ox + slack) / s),
                       "_c": F.when(crossed, F.ceil((_crossing_x(bottom) - ox) / s) - 1)})
    e = cut(e)                                  # read below by each of the three results, as is the row of corners
    cells = e.withColumn("_bx", F.explode(F.sequence("_a", "_z")))
    border = cells.select(key, "_bx", "_by", F.struct("x1", "y1", "x2", "y2").alias("edge"), "turn")
    # parity at the corners: crossings of the row's lower line further right
    touched = cells.groupBy(key, "_by", "_bx").agg(F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_own"))
    crossings = e.where("_c IS NOT NULL").groupBy(key, "_by", F.col("_c").alias("_bx")).agg(F.count("*").alias("_n"), F.lit(False).alias("_own"))
    row = touched.unionByName(crossings).groupBy(key, "_by", "_bx").agg(F.sum("_n").alias("_n"), F.max("_own").alias("_own"))
    right = Window.partitionBy(key, "_by").orderBy(F.desc("_bx"))
    row = row.withColumn("_sum", F.sum("_n").over(right)).withColumn("_next", F.min(F.when(F.col("_own"), F.col("_bx"))).over(
        right.rowsBetween(Window.unboundedPreceding, -1)))
    row = cut(row)
    corner = row.where("_own").select(key, "_bx", "_by", (F.col("_sum") % 2).cast("int").alias("base"))
    run = row.where("_own AND _next > _bx + 1").select(key, "_by", "_bx", "_next", ((F.col("_sum") - F.col("_n")) % 2).alias("_in"))
    # crossings that lie in cells without an edge (exactly on a corner) sit between a border cell and its run
    run = run.where("_in = 1").select(key, "_by", (F.col("_bx") + 1).alias("_l"), F.col("_next").alias("_r"))
    top = F.ceil(F.log2((F.col("_r") - F.col("_l")).cast("double"))).cast("int") + 1
    run = run.withColumn("_level", F.explode(F.sequence(F.lit(0), top)))
    step = F.expr("shiftleft(1L, _level)")
    run = run.withColumns({"_i": F.ceil(F.col("_l") / step), "_j": F.floor(F.col("_r") / step)}).where("_i < _j")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    blocks = F.filter(F.array(F.when(odd("_i"), F.col("_i")), F.when(odd("_j") & (F.col("_j") - 1 >= F.col("_i") + F.pmod(F.col("_i"), F.lit(2))), F.col("_j") - 1)),
                      lambda x: x.isNotNull())
    inside = run.select(key, "_by", "_level", F.explode(blocks).alias("_bx"))
    return border, corner, inside


# ---- points ----------------------------------------------------------------------
def points_in_areas(points: DataFrame, areas: DataFrame, size: float, key: str, x: str, y: str, shape: str, poly: str) -> DataFrame:
    """(key, poly) for every point in an area; points without finite coordinates are in none."""
    s = float(size)
    border, corner, inside = cover(as_parts(areas.select(poly, shape), shape), poly, shape, size)
    p = points.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf"))).withColumns(
        {"_bx": F.floor(F.col("_x") / s), "_by": F.floor(F.col("_y") / s)})
    parity = corner.select(poly, "_bx", "_by", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("edge"), "base")
    rows = border.select(poly, "_bx", "_by", "edge", F.lit(0).alias("base")).unionByName(parity)
    j = salted_join(p, rows, ["_bx", "_by"], key).select(key, poly, "_x", "_y", "base", (F.col("_bx") * s).alias("_x0"), (F.col("_by") * s).alias("_y0"), "edge.*")
    cx, cy = _crossing_x(F.col("_y")), _crossing_y(F.col("_x0"))
    across = ((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))) & (cx > F.col("_x0")) & (cx <= F.col("_x"))
    slope = F.signum((F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    above = (cy > F.col("_y0")) | ((cy == F.col("_y0")) & (slope > 0))
    below = (cy < F.col("_y")) | ((cy == F.col("_y")) & (slope <= 0))
    up = ((F.col("x1") > F.col("_x0")) != (F.col("x2") > F.col("_x0"))) & above & below
    count = F.col("base") + F.coalesce(across.cast("int"), F.lit(0)) + F.coalesce(up.cast("int"), F.lit(0))
    edge = j.groupBy(key, poly).agg(F.sum(count).alias("_n")).where("_n % 2 = 1").select(key, poly)
    levels = [r[0] for r in inside.select("_level").distinct().collect()]          # some 60 at most
    if not levels:
        return edge
    wide = p.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    wide = wide.withColumn("_bx", F.floor(F.col("_bx") / F.expr("shiftleft(1L, _level)")))
    whole = salted_join(wide, inside, ["_by", "_level", "_bx"], key).select(key, poly)
    return edge.unionByName(whole)


# ---- overlays --------------------------------------------------------------------
def cell_areas(areas: DataFrame, step: float, ox: float, oy: float, key: str, shape: str) -> DataFrame:
    """(key, _bx, _by, inside): the area that each area has in each cell it reaches into.

    In a border cell it is the integral over the cell's own edges of what lies right of them, and, along the cell's left side,
    the length that is inside times the cell's width; both are sums over edges, so nothing is clipped or put together again.
    """
    s = float(step)
    border, corner, inside = cover(as_parts(areas.select(key, shape), shape), key, shape, s, ox, oy)
    left, low = ox + F.col("_bx") * s, oy + F.col("_by") * s
    d = G.pin(border.select(key, "_bx", "_by", "turn", "edge.*", left.alias("_x0"), low.alias("_y0")),
              _g=F.struct(F.least(F.greatest("y1", "_y0"), F.col("_y0") + s).alias("a"), F.least(F.greatest("y2", "_y0"), F.col("_y0") + s).alias("b")))
    level = F.col("y1") == F.col("y2")
    xa = F.when(level, F.col("x1")).otherwise(_crossing_x(F.col("_g.a"))) - F.col("_x0")
    xb = F.when(level, F.col("x2")).otherwise(_crossing_x(F.col("_g.b"))) - F.col("_x0")
    d = G.pin(d, _h=F.struct(xa.alias("p"), xb.alias("q")))
    p, q, dy = F.col("_h.p"), F.col("_h.q"), F.col("_g.b") - F.col("_g.a")
    # mean over the edge of x clamped to the cell, from the integral of the clamp
    f = lambda v: F.when(v <= 0, 0.0).when(v >= s, s * v - s * s / 2).otherwise(v * v / 2)
    mean = F.when(F.abs(q - p) > 1e-12 * s, F.try_divide(f(q) - f(p), q - p)).otherwise(F.least(F.greatest((p + q) / 2, F.lit(0.0)), F.lit(s)))
    # an edge left of the cell counts by the left side's length instead
    beside = F.least(F.greatest(F.when(p == q, F.when(p > 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.greatest(p, q) - F.greatest(F.least(p, q), F.lit(0.0)), F.abs(q - p))),
                                F.lit(0.0)), F.lit(1.0))
    part = -F.col("turn") * dy * (s * beside - mean)
    cy = _crossing_y(F.col("_x0"))
    rises = (F.col("x1") > F.col("_x0")) != (F.col("x2") > F.col("_x0"))
    slope = F.signum((F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    here = ((cy > F.col("_y0")) | ((cy == F.col("_y0")) & (slope > 0))) & (cy < F.col("_y0") + s)
    side = F.when(rises & here, F.col("turn") * F.signum(F.col("x2") - F.col("x1")) * (F.col("_y0") + s - cy) * s).otherwise(0.0)
    sums = d.select(key, "_bx", "_by", (part + side).alias("inside")).unionByName(
        corner.where("base = 1").select(key, "_bx", "_by", F.lit(s * s).alias("inside")))
    edge = sums.groupBy(key, "_bx", "_by").agg(F.sum("inside").alias("inside"))
    step_ = F.expr("shiftleft(1L, _level)")
    whole = inside.select(key, F.explode(F.sequence(F.col("_bx") * step_, (F.col("_bx") + 1) * step_ - 1)).alias("_bx"), "_by", F.lit(s * s).alias("inside"))
    return edge.unionByName(whole)


# ---- interior points -------------------------------------------------------------
def with_interior_point(areas: DataFrame, shape: str = "parts", px: str = "px", py: str = "py") -> DataFrame:
    """A point certain to lie in the area: its centroid if inside, else the middle of the widest inner span at the mid-height of its largest part.

    Where that line meets no inside (a part of no height), the point is null.
    """
    d = as_parts(areas, shape)
    names = [c for c in d.columns if c not in (px, py)]
    part = F.array_max(F.transform(F.col(shape), lambda p: F.struct(F.abs(_twice(p["ring"])).alias("a"), (
        (F.array_min(F.transform(p["ring"], lambda v: v["y"])) + F.array_max(F.transform(p["ring"], lambda v: v["y"]))) / 2).alias("mid"))))
    all_edges = F.flatten(F.transform(rings(F.col(shape)), lambda r: G.edges(G.close_ring(r["ring"]))))

    def moments(r):
        o = F.element_at(r["ring"], 1)
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(acc, e):
            ax, ay, bx, by = e["x1"] - o["x"], e["y1"] - o["y"], e["x2"] - o["x"], e["y2"] - o["y"]
            c = ax * by - bx * ay
            return F.struct((acc["s"] + c).alias("s"), (acc["x"] + (ax + bx) * c).alias("x"), (acc["y"] + (ay + by) * c).alias("y"))
        m = F.aggregate(G.edges(G.close_ring(r["ring"])), zero, add)
        w = r["role"] * F.signum(m["s"])
        return F.struct((w * m["s"]).alias("s"), (w * (m["x"] + 3 * o["x"] * m["s"])).alias("x"), (w * (m["y"] + 3 * o["y"] * m["s"])).alias("y"))
    d = G.pin(d, _e=all_edges, _m=F.transform(rings(F.col(shape)), moments), _mid=part["mid"])
    total = lambda k: F.aggregate("_m", F.lit(0.0), lambda a, m: a + m[k])
    d = G.pin(d, _s=total("s"), _sx=total("x"), _sy=total("y"))
    d = G.pin(d, _cx=F.when(F.col("_s") != 0, F.col("_sx") / (3 * F.col("_s"))), _cy=F.when(F.col("_s") != 0, F.col("_sy") / (3 * F.col("_s"))))
    x_at = lambda e, y: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    meets = lambda y: F.filter("_e", lambda e: (e["y1"] > y) != (e["y2"] > y))
    d = G.pin(d, _ok=F.coalesce(F.size(F.filter(meets(F.col("_cy")), lambda e: x_at(e, F.col("_cy")) > F.col("_cx"))) % 2 == 1, F.lit(False)))
    d = G.pin(d, _xs=F.array_sort(F.transform(meets(F.col("_mid")), lambda e: x_at(e, F.col("_mid")))))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_xs") - 1, F.lit(1)), F.lit(2)), lambda i: F.struct(
        (F.get("_xs", i) - F.get("_xs", i - 1)).alias("w"), ((F.get("_xs", i) + F.get("_xs", i - 1)) / 2).alias("x")))
    d = G.pin(d, _best=F.array_max(spans))
    return d.select(*names, F.when(F.col("_ok"), F.col("_cx")).otherwise(F.col("_best.x")).alias(px),
                    F.when(F.col("_ok"), F.col("_cy")).when(F.col("_best.x").isNotNull(), F.col("_mid")).alias(py))
