"""Planar geometry on ``array<struct<x double, y double>>`` as Columns.

Lines and simple rings are arrays of vertices in order; a ring need not repeat
its first vertex.  All distances are in the units of the coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x, y) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def rect_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def edges(line: Column) -> Column:
    """Consecutive vertex pairs as array<struct<x1,y1,x2,y2>>."""
    n = F.size(line)
    return F.zip_with(
        F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                              b["x"].alias("x2"), b["y"].alias("y2")))


def close_ring(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def edge_length(e: Column) -> Column:
    return F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])


def line_length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda acc, e: acc + edge_length(e))


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a straight edge."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def point_line_distance(px: Column, py: Column, line: Column) -> Column:
    return F.array_min(F.transform(
        edges(line), lambda e: segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))


def farthest_vertex(px: Column, py: Column, line: Column) -> Column:
    return F.array_max(F.transform(line, lambda v: F.hypot(v["x"] - px, v["y"] - py)))


def _cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _edges_meet(a: Column, b: Column) -> Column:
    d1 = _cross(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d2 = _cross(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    d3 = _cross(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d4 = _cross(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def edge_edge_distance(a: Column, b: Column) -> Column:
    """Zero where the edges cross, else the smallest end-to-edge distance."""
    ends = F.least(
        segment_distance(a["x1"], a["y1"], b["x1"], b["y1"], b["x2"], b["y2"]),
        segment_distance(a["x2"], a["y2"], b["x1"], b["y1"], b["x2"], b["y2"]),
        segment_distance(b["x1"], b["y1"], a["x1"], a["y1"], a["x2"], a["y2"]),
        segment_distance(b["x2"], b["y2"], a["x1"], a["y1"], a["x2"], a["y2"]))
    return F.when(_edges_meet(a, b), F.lit(0.0)).otherwise(ends)


def line_line_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.transform(
        edges(a), lambda ea: F.array_min(F.transform(
            edges(b), lambda eb: edge_edge_distance(ea, eb)))))


def at_distance(line: Column, d: Column) -> Column:
    """The point ``d`` along the line, as a struct<x,y>."""
    start = F.struct(d.cast("double").alias("left"), F.lit(None).cast("double").alias("x"),
                     F.lit(None).cast("double").alias("y"))

    def walk(acc, e):
        length = edge_length(e)
        here = acc["x"].isNull() & (acc["left"] <= length)
        f = F.when(length > 0, acc["left"] / length).otherwise(F.lit(0.0))
        return F.struct(
            F.when(acc["x"].isNull() & ~here, acc["left"] - length)
             .otherwise(acc["left"]).alias("left"),
            F.when(here, e["x1"] + f * (e["x2"] - e["x1"])).otherwise(acc["x"]).alias("x"),
            F.when(here, e["y1"] + f * (e["y2"] - e["y1"])).otherwise(acc["y"]).alias("y"))

    got = F.aggregate(edges(line), start, walk)
    last = F.element_at(line, -1)
    return F.struct(F.coalesce(got["x"], last["x"]).alias("x"),
                    F.coalesce(got["y"], last["y"]).alias("y"))


def ring_area(ring: Column) -> Column:
    twice = F.aggregate(edges(close_ring(ring)), F.lit(0.0),
                        lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2.0)


def bbox(line: Column) -> tuple[Column, Column, Column, Column]:
    xs = F.transform(line, lambda v: v["x"])
    ys = F.transform(line, lambda v: v["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd ray cast; half-open in y, so shared borders belong to one side."""
    hits = F.aggregate(
        edges(close_ring(ring)), F.lit(0),
        lambda acc, e: acc + F.when(
            ((e["y1"] > py) != (e["y2"] > py))
            & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
            1).otherwise(0))
    return hits % 2 == 1


def _clip_half(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """Clip a ring to one side of an axis-parallel line."""
    other = "y" if axis == "x" else "x"

    def inside(v):
        return v[axis] >= bound if keep_above else v[axis] <= bound

    def cut(a, b):
        t = (bound - a[axis]) / (b[axis] - a[axis])
        o = a[other] + t * (b[other] - a[other])
        return point(bound, o) if axis == "x" else point(o, bound)

    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
                   F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def emit(p):
        a, b = p["a"], p["b"]
        none = F.slice(F.array(a), 1, 0)
        return (F.when(inside(a) & inside(b), F.array(b))
                 .when(inside(a), F.array(cut(a, b)))
                 .when(inside(b), F.array(cut(a, b), b))
                 .otherwise(none))

    return F.when(F.size(ring) > 0, F.flatten(F.transform(pairs, emit))).otherwise(ring)


CLIP_SIDES = [("x", "x0", True), ("x", "x1", False), ("y", "y0", True), ("y", "y1", False)]


def clip_side(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    return _clip_half(ring, axis, bound, keep_above)


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so each is computed once per row.

    The optimiser merges stacked projections; a long geometry expression used
    several times downstream would be copied, and inside a lambda re-evaluated
    per element.  A generator is not merged.
    """
    for name, c in cols.items():
        keep = [x for x in df.columns if x != name]
        df = df.select(*keep, F.explode(F.array(c)).alias(name))
    return df


def with_representative_point(df: DataFrame, ring: str = "ring", px: str = "px", py: str = "py") -> DataFrame:
    """A point certain to lie in the ring: its area centroid if inside, else the middle of
    the widest span of the interior at mid-height."""
    r = F.col(ring)
    ox, oy = r[0]["x"], r[0]["y"]

    def add(acc, e):
        ax, ay, bx, by = e["x1"] - acc["ox"], e["y1"] - acc["oy"], e["x2"] - acc["ox"], e["y2"] - acc["oy"]
        c = ax * by - bx * ay
        return F.struct((acc["s"] + c).alias("s"), (acc["x"] + (ax + bx) * c).alias("x"),
                        (acc["y"] + (ay + by) * c).alias("y"), acc["ox"].alias("ox"), acc["oy"].alias("oy"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), ox.alias("ox"), oy.alias("oy"))
    d = pin(df, _e=edges(close_ring(r)), _m=F.aggregate(edges(close_ring(r)), zero, add))
    m = F.col("_m")
    mean = lambda k: F.aggregate(r, F.lit(0.0), lambda a, v: a + v[k]) / F.size(r)
    d = pin(d, _c=F.struct(
        F.when(m["s"] != 0, ox + m["x"] / (3.0 * m["s"])).otherwise(mean("x")).alias("x"),
        F.when(m["s"] != 0, oy + m["y"] / (3.0 * m["s"])).otherwise(mean("y")).alias("y")))
    d = pin(d, _cx=F.col("_c.x"), _cy=F.col("_c.y"))
    d = pin(d, _ok=in_ring(F.col("_cx"), F.col("_cy"), r), _mid=(bbox(r)[1] + bbox(r)[3]) / 2.0)
    mid = F.col("_mid")
    crossing = F.filter("_e", lambda e: (e["y1"] > mid) != (e["y2"] > mid))
    d = pin(d, _xs=F.array_sort(F.transform(
        crossing, lambda e: e["x1"] + (mid - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))))
    xs = F.col("_xs")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1)), F.lit(2)),
                        lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("w"),
                                           ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("x")))
    d = pin(d, _best=F.array_max(spans))
    keep = [c for c in df.columns if c not in (px, py)]
    return d.select(*keep, F.when(F.col("_ok"), F.col("_cx")).otherwise(F.col("_best.x")).alias(px),
                    F.when(F.col("_ok"), F.col("_cy")).otherwise(mid).alias(py))
