"""Areas with parts and holes against plain ray casting and clipping, at bucket sizes far from the areas' own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import geometry as G
from panelwright.operators import areas as A
from panelwright.operators import spatial

SCHEMA = "zone int, parts array<struct<ring:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def star(r, cx, cy, a, b, n, turn=1):
    out = []
    for k in range(n):
        d = a if k % 2 else b
        t = turn * 2 * math.pi * k / n
        out.append((cx + d * math.cos(t), cy + d * math.sin(t)))
    return out


def shapes():
    r = np.random.default_rng(6)
    out = [(0, [([(0, 0), (30, 0), (30, 30), (0, 30)], [[(10, 10), (10, 20), (20, 20), (20, 10)]])]),                      # a hole on bucket lines
           (1, [([(40, 0), (50, 0), (50, 10), (40, 10)], []), ([(60, 0), (60, 10), (70, 10), (70, 0)], [])]),                 # two parts, turned both ways
           (2, [(star(r, 20, 70, 25, 9, 40), [star(r, 20, 70, 5, 3, 11, -1)])]),
           (3, [([(0, 0), (10, 10), (20, 0), (10, -10)], [])]),                                                              # slanted edges through bucket corners
           (4, [([(-500, -500), (500, -500), (500, 500), (-500, 500)], [star(r, 0, 0, 400, 350, 60)])]),
           (5, [([(5, 5), (5, 5), (5, 5)], [])]), (6, [([(1, 1), (2, 2)], [])]), (7, [])]
    return out


def frame(spark, rows):
    pt = lambda v: {"x": float(v[0]), "y": float(v[1])}
    return spark.createDataFrame([(k, [{"ring": [pt(v) for v in ring], "holes": [[pt(v) for v in h] for h in holes]} for ring, holes in parts])
                                  for k, parts in rows], SCHEMA)


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                hit = not hit
    return hit


def rings_of(parts):
    return [r for ring, holes in parts for r in (ring, *holes) if len(r) >= 3]


def points():
    r = np.random.default_rng(9)
    pts = [(float(x), float(y)) for x, y in r.uniform(-60, 110, (400, 2))] + [(float(x), float(y)) for x, y in r.integers(-4, 10, (300, 2)) * 10]
    pts += [(float(x), float(y)) for x, y in r.uniform(-520, 520, (200, 2))] + [(15.0, 15.0)] * 200
    return pts + [(float(x) + 0.5, float(y)) for x, y in r.integers(-2, 8, (60, 2)) * 10]


@pytest.mark.parametrize("size", [0.9, 10.0, 37.0, 5000.0])
def test_points_in_areas(spark, size):
    """Buckets from a thousandth of the largest area to all of it; points on corners and bucket lines; a crowd."""
    pts, rows = points(), shapes()
    got = spatial.pip_join(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id int, px double, py double"),
                           frame(spark, rows), size, ring="parts", how="inner", first=False)
    have = {(r.id, r.zone) for r in got.select("id", "zone").collect()}
    want = {(i, k) for i, (x, y) in enumerate(pts) for k, parts in rows if inside(x, y, rings_of(parts))}
    assert have == want and got.count() == len(want)


def clipped(ring, x0, y0, x1, y1):
    for axis, bound, above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = (a[axis] >= bound) == above or a[axis] == bound, (b[axis] >= bound) == above or b[axis] == bound
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(bound if q == axis else a[q] + t * (b[q] - a[q]) for q in (0, 1)))
            if inb:
                out.append(b)
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@pytest.mark.parametrize("step", [7.0, 10.0, 33.0])
def test_overlay(spark, step):
    rows = [s for s in shapes() if s[0] != 4 or step > 30]
    got = {(r.zone, r.row_, r.col_): r.frac for r in spatial.area_overlay(frame(spark, rows), step, 3.0, 1000.0, key="zone", shape="parts").collect()}
    area = lambda ring: clipped(ring, -1e6, -1e6, 1e6, 1e6)
    want = {}
    for k, parts in rows:
        whole = sum(area(ring) - sum(map(area, holes)) for ring, holes in parts)
        if whole < 1e-9:
            continue
        xs, ys = zip(*[v for ring, _ in parts for v in ring])
        for col in range(math.floor((min(xs) - 3) / step - 1), math.ceil((max(xs) - 3) / step + 2)):
            for row in range(math.floor((1000 - max(ys)) / step - 1), math.ceil((1000 - min(ys)) / step + 2)):
                box = (3 + (col - 0.5) * step, 1000 - (row + 0.5) * step, 3 + (col + 0.5) * step, 1000 - (row - 0.5) * step)
                f = sum(clipped(ring, *box) - sum(clipped(h, *box) for h in holes) for ring, holes in parts) / whole
                if f > 2e-6:
                    want[(k, row, col)] = f
    for k, f in want.items():
        assert got[k] == pytest.approx(f, abs=1e-9)
    assert all(f <= 3e-6 for k, f in got.items() if k not in want and k[0] < 5)


def test_interior_points(spark):
    d = A.with_interior_point(frame(spark, shapes()))
    got = {r.zone: (r.px, r.py) for r in d.collect()}
    for k, parts in shapes():
        if k < 5:
            assert inside(*got[k], rings_of(parts)), k
        else:
            assert got[k] == (None, None), (k, got[k])


def test_area_and_nulls(spark):
    d = frame(spark, shapes()).unionByName(spark.createDataFrame([(9, None)], SCHEMA))
    got = {r.zone: r.a for r in d.select("zone", A.area(F.col("parts")).alias("a")).collect()}
    assert got[0] == 800 and got[1] == 200 and got[3] == 200 and got[5] == got[6] == 0.0
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 5.0), (3, float("nan"), 1.0)], "id int, px double, py double")
    out = {r.id: r.zone for r in spatial.pip_join(pts, d, 10.0, ring="parts").collect()}
    assert out == {1: 0, 2: None, 3: None}
    assert spatial.pip_join(pts, d.limit(0), 10.0, ring="parts").where("zone is not null").count() == 0


def test_areas_are_dealt_out_before_the_geometry(spark):
    """A file of few bytes is one task when read; its edges and interior points must not be worked out in that task."""
    one = spark.range(3).coalesce(1).select(F.col("id").alias("b"), G.rect_ring(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("ring"))
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "REPARTITION_BY_COL" in plan(A.area_edges(A.as_parts(one, "ring"), "b", "ring"))
    assert "REPARTITION_BY_COL" in plan(spatial.area_overlay(one, 5.0, 0.0, 0.0))
