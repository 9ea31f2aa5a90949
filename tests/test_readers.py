"""Readers against small landed files."""

import json

import __spark_entry__ as entry
from harness import compare, duck
from panelwright.sources import readers

SMALL = "/root/testdata/sf0.001"


def test_geojson_parts_and_holes(spark, tmp_path):
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    shapes = [(1, "Polygon", [square(0, 0, 9), square(2, 2, 1), square(5, 5, 2)]), (2, "MultiPolygon", [[square(0, 0, 1)], [square(20, 20, 4), square(21, 21, 1)]]),
              (3, "Point", [1, 1]), (4, "MultiPolygon", [[square(90, 90, 1)]])]
    lines = [json.dumps({"type": "Feature", "properties": {"id": i}, "geometry": {"type": t, "coordinates": c}}) for i, t, c in shapes]
    (tmp_path / "zones.geojsonseq").write_text("\n".join(lines))
    got = {r.id: r for r in readers.scan_geojsonseq(spark, str(tmp_path), (0.0, 0.0, 30.0, 30.0)).collect()}
    assert set(got) == {1, 2}
    told = {i: [[[(v.x, v.y) for v in p.ring], *[[(v.x, v.y) for v in h] for h in p.holes]] for p in r.parts] for i, r in got.items()}
    want = {1: [shapes[0][2]], 2: shapes[1][2]}
    assert told == {i: [[[tuple(map(float, v)) for v in ring[:-1]] for ring in p] for p in c] for i, c in want.items()}
    assert [got[2][k] for k in ("minx", "miny", "maxx", "maxy")] == [0, 0, 24, 24]


def test_geojson_query_equals_its_twin(spark):
    assert compare(entry.queries()["scan_geojsonseq"](spark, SMALL), duck(SMALL), entry.oracle_sql()["scan_geojsonseq"]) is None
