"""Planar joins by uniform buckets: points, lines, rings, boxes.

Every join is an equi-join on bucket numbers followed by an exact test.  A
bucket that holds many rows of the probing side is split by salt: its size is
counted first, its rows are spread over as many salts as needed, and the other
side's rows of that bucket are repeated per salt.  Coincident points are
collapsed before any pair is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import geometry as G
from panelwright.session import cut

SALT_ROWS = 50_000
NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def bucket(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], tie: str,
                rows_per_task: int = SALT_ROWS) -> DataFrame:
    """Inner equi-join where a bucket's left rows are split over salts in proportion to its count."""
    hot = left.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_n")).where("_n > 1")
    l = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(tie), F.col("_n"))).cast("int")).drop("_n")
    r = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return shuffled(l, r, [*keys, "_salt"]).drop("_salt")


def shuffled(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by shuffle: rows repeated into buckets are far more than the planner expects, and must not be sent to the driver."""
    return left.join(right.hint("merge"), keys)


def in_buckets(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_bx": bucket(F.col(x), size), "_by": bucket(F.col(y), size)})


def around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Repeat a point into its own and the eight neighbouring buckets."""
    arms = F.array(*[F.struct((bucket(F.col(x), size) + i).alias("_bx"), (bucket(F.col(y), size) + j).alias("_by"))
                     for i, j in NEIGHBOURS])
    return df.withColumn("_nb", F.explode(arms)).select(*df.columns, "_nb._bx", "_nb._by")


def over_box(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """Repeat a row into every bucket its box touches."""
    d = df.withColumn("_bx", F.explode(F.sequence(bucket(x0, size), bucket(x1, size))))
    return d.withColumn("_by", F.explode(F.sequence(bucket(y0, size), bucket(y1, size))))


def boxes_within(left: DataFrame, right: DataFrame, a: str, b: str, r: float, size: float, tie: str) -> DataFrame:
    """Pairs of rows whose shapes ``a`` and ``b`` have boxes within ``r`` of each other, each pair once.

    Of the buckets that a pair shares, only that of the lower left corner of the common part keeps it.
    """
    reach = r * (1.0 + 1e-6)                    # boxes only screen, so rounding must not lose a pair
    box = lambda shape, m: dict(zip(("x0", "y0", "x1", "y1"), (v + d for v, d in zip(G.bbox(F.col(shape)), (-m, -m, m, m)))))
    side = lambda df, p, shape, m: df.withColumns({f"_{p}{k}": v for k, v in box(shape, m).items()})
    over = lambda df, p: over_box(df, *[F.col(f"_{p}{k}") for k in ("x0", "y0", "x1", "y1")], size)
    j = salted_join(over(side(left, "l", a, 0.0), "l"), over(side(right, "r", b, reach), "r"), ["_bx", "_by"], tie)
    low = lambda c: bucket(F.greatest(f"_l{c}0", f"_r{c}0"), size) == F.col(f"_b{c}")
    meet = lambda c: (F.col(f"_l{c}0") <= F.col(f"_r{c}1")) & (F.col(f"_r{c}0") <= F.col(f"_l{c}1"))
    return j.where(low("x") & low("y") & meet("x") & meet("y")).select(*left.columns, *right.columns)


def radius_pairs(points: DataFrame, r: float, key: str = "id", x: str = "x", y: str = "y",
                 within: list[str] = ()) -> DataFrame:
    """Ordered pairs of distinct points within ``r`` (i, j, d): the sparse distance kernel.

    Buckets are r wide, so a point meets only its 3x3 block; hot blocks are salted.
    """
    base = points.select(*within, F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    other = points.select(*within, F.col(key).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    j = salted_join(in_buckets(base, "xi", "yi", r), around(other, "xj", "yj", r), [*within, "_bx", "_by"], "i")
    d = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    return j.withColumn("d", d).where((F.col("d") <= r) & (F.col("i") != F.col("j"))).select(*within, "i", "j", "d")


def radius_sum(query: DataFrame, points: DataFrame, r: float, weight: Column | None = None, key: str = "id",
               out: str = "n", within: list[str] = ()) -> DataFrame:
    """Sum of point weights (or their count) within ``r`` of each query place (x, y).

    Points are first summed per place.  Fine buckets that lie wholly inside the
    circle add their total without any pair; only rim buckets meet point by
    point, and those pairs are summed on the map side.
    """
    w = F.lit(1.0) if weight is None else weight
    side = r / 4.0
    place = points.groupBy(*within, F.col("x").alias("px"), F.col("y").alias("py")).agg(F.sum(w).alias("pw"))
    place = in_buckets(place, "px", "py", side)
    cells = place.groupBy(*within, "_bx", "_by").agg(F.sum("pw").alias("cw"))
    reach = [(i, j) for i in range(-5, 6) for j in range(-5, 6)
             if math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) <= 4.0]
    q = query.select(*within, F.col(key).alias("_q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    arms = F.array(*[F.struct((bucket(F.col("qx"), side) + i).alias("_bx"), (bucket(F.col("qy"), side) + j).alias("_by"))
                     for i, j in reach])
    q = q.withColumn("_nb", F.explode(arms)).select(*within, "_q", "qx", "qy", "_nb._bx", "_nb._by")
    far = lambda v, b: F.greatest(F.abs(F.col(v) - F.col(b) * side), F.abs(F.col(v) - (F.col(b) + 1) * side))
    q = q.withColumn("_whole", F.hypot(far("qx", "_bx"), far("qy", "_by")) <= r)
    k = [*within, "_bx", "_by"]
    inner = shuffled(q.where("_whole"), cells, k).groupBy(*within, "_q").agg(F.sum("cw").alias("s"))
    rim = salted_join(q.where("not _whole"), place, k, "_q").where(
        F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) <= r)
    rim = rim.groupBy(*within, "_q").agg(F.sum("pw").alias("s"))
    tot = inner.unionByName(rim).groupBy(*within, "_q").agg(F.sum("s").alias(out)).withColumnRenamed("_q", key)
    return query.join(tot, [*within, key], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def line_edges(lines: DataFrame, key: str = "seg_id", line: str = "line", within: list[str] = ()) -> DataFrame:
    # lines lie in few bytes, so one task would cut and repeat them all
    dealt = lines.select(*within, key, line).repartition(*within, key)
    return dealt.select(*within, key, F.explode(G.edges(F.col(line))).alias("_e")).select(*within, key, "_e.*")


def nearest_line_join(points: DataFrame, lines: DataFrame, max_dist: float, key: str = "id", x: str = "px", y: str = "py",
                      seg: str = "seg_id", line: str = "line") -> DataFrame:
    """Each point with its nearest line within ``max_dist`` (ties to the smallest id) and the distance."""
    e = line_edges(lines, seg, line)
    m = float(max_dist)
    size = 2.0 * m
    e = over_box(e, F.least("x1", "x2") - m, F.least("y1", "y2") - m, F.greatest("x1", "x2") + m, F.greatest("y1", "y2") + m, size)
    p = in_buckets(points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", size)
    j = salted_join(p, e, ["_bx", "_by"], key)
    d = G.segment_distance(F.col("_x"), F.col("_y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = j.withColumn("_d", d).where(F.col("_d") <= m).groupBy(key).agg(
        F.min(F.struct(F.col("_d").alias("snap_m"), F.col(seg))).alias("_b"))
    # a caller's "seg is not null" makes the join an inner one: the points must not be sent to the driver either
    return points.join(best.select(key, f"_b.{seg}", "_b.snap_m").hint("merge"), key, "left")


def pip_join(points: DataFrame, polygons: DataFrame, size: float, key: str = "id", x: str = "px", y: str = "py",
             ring: str = "ring", poly: str = "zone", how: str = "left", first: bool = True) -> DataFrame:
    """Point in polygon; where several hold a point, the smallest polygon id is kept (``first``).

    ``ring`` names a column of simple rings or of parts with holes.  Polygons are not copied
    into the cells of width ``size``: see ``areas.cover``.
    """
    from panelwright.operators.areas import points_in_areas
    hit = points_in_areas(points, polygons, size, key, x, y, ring, poly)
    pairs = hit.groupBy(key).agg(F.min(poly).alias(poly)) if first else hit
    return points.join(pairs.hint("merge"), key, how)


def point_in_footprint_flag(buildings: DataFrame, shops: DataFrame, size: float, key: str = "b", shape: str = "ring") -> DataFrame:
    """Unknown or other buildings holding any shop/office point become commercial."""
    return _commercial(buildings, _holding(buildings, shops, size, key, shape), key)


def _holding(buildings: DataFrame, shops: DataFrame, size: float, key: str, shape: str) -> DataFrame:
    return pip_join(shops, buildings.select(key, shape), size, ring=shape, poly=key, how="inner", first=False).select(key).distinct()


def _commercial(buildings: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    d = buildings.join(hits.withColumn("_hit", F.lit(True)), key, "left")
    up = F.col("_hit") & F.col("bldg_class").isin("unknown", "other")
    return d.withColumn("bldg_class", F.when(up, "commercial").otherwise(F.col("bldg_class"))).drop("_hit")


def tag_footprints(buildings: DataFrame, shapes: DataFrame, shops: DataFrame, size: float, key: str = "b", shape: str = "ring",
                   tag: str = "tag", tagged: str = "parts") -> DataFrame:
    """Use classes of mapped shapes (shape_id, tag, parts) and shop points moved onto footprints, as ``bldg_class``.

    A footprint takes the class of the shape that holds its interior point, of several the one of
    smallest id; without one it is unknown.  Unknown and other footprints that hold a shop or office point become commercial.
    """
    from panelwright.operators.areas import with_interior_point
    at = cut(with_interior_point(buildings.select(key, shape).repartition(key), shape, "_px", "_py").select(key, "_px", "_py"))     # a join reads its points several times
    hit = pip_join(at, shapes, size, key, "_px", "_py", ring=tagged, poly="shape_id", how="inner")
    got = hit.join(shapes.select("shape_id", F.col(tag).alias("_tag")), "shape_id").select(key, "_tag")
    d = buildings.drop("bldg_class").join(got, key, "left").withColumn("bldg_class", F.coalesce("_tag", F.lit("unknown"))).drop("_tag")
    # points meet the given footprints, not those just classed, which would class them anew for every use
    return _commercial(d, _holding(buildings, shops, size, key, shape), key)


def knn_join(points: DataFrame, k: int, key: str = "id", x: str = "x", y: str = "y", crowd: int = 4,
             max_levels: int = 60) -> DataFrame:
    """Each point's k nearest others (i, j, d, rank), ties by (distance, id).

    Places, not points, do the searching: a place keeps only its k+1 smallest
    ids, which is exact because no larger id there can be among the k nearest.
    The search starts at a bucket so fine that no bucket holds more than a small
    crowd and doubles it; a place is settled once k+1 candidates lie within one
    bucket width.  Few places of a crowded bucket ever remain for a coarser
    level, so crowds do not meet all against all.
    """
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = cut(p)                                  # read again at the end
    w = Window.partitionBy("x", "y").orderBy("id")
    heads = p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).select("id", "x", "y")
    heads = cut(heads)
    places = heads.groupBy("x", "y").agg(F.count("*").alias("c"))
    ext = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    span = max(ext[1] - ext[0], ext[3] - ext[2], 1e-9)
    size = span / max(1.0, math.sqrt(ext[4] / (k + 1.0)))
    while True:
        most = in_buckets(places, "x", "y", size).groupBy("_bx", "_by").agg(F.sum("c").alias("c")).agg(F.max("c")).first()[0]
        if most <= crowd * (k + 1) or size < span * 2.0 ** -40:
            break
        size /= 2.0
    open_, done = cut(places.select(F.col("x").alias("qx"), F.col("y").alias("qy"))), []
    for _ in range(max_levels):
        whole = size >= 2 * span
        cand = heads.select("id", F.col("x").alias("cx"), F.col("y").alias("cy"))
        q = around(open_, "qx", "qy", size)
        j = q.join(in_buckets(cand, "cx", "cy", size), ["_bx", "_by"])
        d = F.hypot(F.col("qx") - F.col("cx"), F.col("qy") - F.col("cy"))
        j = j.withColumn("d", d)
        if not whole:
            j = j.where(F.col("d") <= size)
        near = j.withColumn("_r", F.row_number().over(Window.partitionBy("qx", "qy").orderBy("d", "id"))).where(F.col("_r") <= k + 1)
        near = cut(near.select("qx", "qy", "id", "d"))
        full = near.groupBy("qx", "qy").agg(F.count("*").alias("c"))
        ok = full if whole else full.where(F.col("c") >= k + 1)
        done.append(near.join(ok.select("qx", "qy"), ["qx", "qy"], "left_semi"))
        open_ = cut(open_.join(ok.select("qx", "qy"), ["qx", "qy"], "left_anti"))
        if whole or open_.isEmpty():
            break
        size *= 2.0
    else:
        raise RuntimeError(f"places still open after {max_levels} levels; raise max_levels")
    found = done[0]
    for f in done[1:]:
        found = found.unionByName(f)
    # every point of a place reads the place's list, minus itself; a place may hold very many
    # points, and each row's k+1 candidates are ranked by an array sort inside the row
    lists = found.groupBy("qx", "qy").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("_l"))
    own = p.join(lists, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")))
    others = F.slice(F.filter("_l", lambda e: e["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("i"), F.posexplode(others).alias("_p", "_e")).select(
        "i", F.col("_e.id").alias("j"), F.col("_e.d").alias("d"), (F.col("_p") + 1).alias("rank"))


def ring_cross_count(query: DataFrame, lines: DataFrame, r: float, key: str = "id", seg: str = "seg_id") -> DataFrame:
    """Lines crossing the circle of radius r about each (x, y): nearest part inside, some vertex outside."""
    q = query.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"))
    x0, y0, x1, y1 = G.bbox(F.col("line"))
    l = over_box(lines.select(seg, "line"), x0 - r, y0 - r, x1 + r, y1 + r, r)
    j = salted_join(in_buckets(q, "_x", "_y", r), l, ["_bx", "_by"], key)
    near = G.point_line_distance(F.col("_x"), F.col("_y"), F.col("line"))
    far = G.farthest_vertex(F.col("_x"), F.col("_y"), F.col("line"))
    n = j.where((near <= r) & (far >= r)).groupBy(key).agg(F.count("*").alias("permeability"))
    return query.join(n, key, "left").withColumn("permeability", F.coalesce("permeability", F.lit(0)))


def buffer_count_len(segs: DataFrame, ways: DataFrame, r: float, seg: str = "seg_id", way: str = "way_id") -> DataFrame:
    """Count and total length of ways within r of each segment."""
    left, right = segs.select(seg, F.col("line").alias("_a")), ways.select(way, F.col("line").alias("_b"))
    pairs = boxes_within(left, right, "_a", "_b", r, 4.0 * r, seg)
    near = pairs.where(G.line_line_distance(F.col("_a"), F.col("_b")) <= r)
    near = near.groupBy(seg, way).agg(F.max(G.line_length(F.col("_b"))).alias("_len"))
    n = near.groupBy(seg).agg(F.count("*").alias("n_within"), F.sum("_len").alias("len_within"))
    return segs.join(n, seg, "left").withColumns(
        {"n_within": F.coalesce("n_within", F.lit(0)), "len_within": F.coalesce("len_within", F.lit(0.0))})


def area_overlay(buildings: DataFrame, step: float, x0: float, y0: float, key: str = "b", shape: str = "ring") -> DataFrame:
    """Share of each building's area in every grid cell it covers (cells centred on x0 + col*step).

    ``shape`` holds simple rings or parts with holes.  Buildings inside one cell skip the
    geometry, as most do; of the others only border cells are measured.
    """
    from panelwright.operators import areas as A
    d = A.as_parts(buildings.select(key, shape).repartition(key), shape)
    bx0, by0, bx1, by1 = G.bbox(F.flatten(F.transform(F.col(shape), lambda p: p["ring"])))
    d = d.withColumns({"_c0": F.floor((bx0 - x0 + step / 2) / step), "_c1": F.floor((bx1 - x0 + step / 2) / step),
                       "_r0": F.floor((y0 + step / 2 - by1) / step), "_r1": F.floor((y0 + step / 2 - by0) / step)})
    one = (F.col("_c0") == F.col("_c1")) & (F.col("_r0") == F.col("_r1"))
    whole = d.where(one).select(key, F.col("_r0").alias("row_"), F.col("_c0").alias("col_"), F.lit(1.0).alias("frac"))
    many = d.where(~one).select(key, shape)
    cells = A.cell_areas(many, step, x0 - step / 2, y0 + step / 2, key, shape)
    size = many.select(key, F.greatest(A.area(F.col(shape)), F.lit(1e-9)).alias("_area"))
    frac = cells.join(size, key).select(key, (-F.col("_by") - 1).alias("row_"), F.col("_bx").alias("col_"), (F.col("inside") / F.col("_area")).alias("frac"))
    return whole.unionByName(frac.where("frac > 1e-6"))


def bldg_apportion(buildings: DataFrame, zones: DataFrame, cells: DataFrame, step: float, x0: float, y0: float,
                   bucket_size: float, min_area: float = 20.0, shape: str = "ring") -> DataFrame:
    """Zone totals to buildings by residential area, then to cells by area share.

    ``shape`` of buildings and zones holds simple rings or parts with holes.  ``zones``: zone, shape, housing_units, population.  ``cells``: cell, zone, row_, col_, ALAND, land_frac.
    Zones without residential area fall back to land area and are flagged.
    """
    from panelwright.operators.areas import with_interior_point
    at = cut(with_interior_point(buildings.repartition("b"), shape).drop(shape))        # a join reads its points several times
    b = pip_join(at, zones, bucket_size, key="b", ring=shape, poly="zone")
    resid = ~F.col("bldg_class").isin("commercial", "other") & (F.col("area_m2") >= min_area)
    b = b.withColumns({"resid_area": F.when(resid, F.col("area_m2")).otherwise(0.0),
                       "comm_area": F.when(F.col("bldg_class") == "commercial", F.col("area_m2")).otherwise(0.0)})
    per = b.where("zone is not null").groupBy("zone").agg(
        F.sum("resid_area").alias("bg_resid_bldg_area_m2"), F.count("*").alias("bg_bldg_count"))
    z = zones.select("zone", "housing_units", "population")
    b = b.join(per, "zone", "left").join(z, "zone", "left")
    w = F.col("resid_area") / F.when(F.col("bg_resid_bldg_area_m2") != 0, F.col("bg_resid_bldg_area_m2"))
    b = b.withColumns({"_units": F.coalesce(F.col("housing_units") * w, F.lit(0.0)), "_pop": F.coalesce(F.col("population") * w, F.lit(0.0))})
    ov = area_overlay(buildings, step, x0, y0, shape=shape).join(
        b.select("b", "area_m2", "resid_area", "comm_area", "_units", "_pop", "px", "py"), "b")
    own = ((F.floor((F.col("px") - x0) / step + 0.5) == F.col("col_")) & (F.floor((y0 - F.col("py")) / step + 0.5) == F.col("row_")))
    part = lambda c, n: F.sum(F.col(c) * F.col("frac")).alias(n)
    cell = ov.groupBy("row_", "col_").agg(
        F.count_if(own).alias("bldg_count"), part("area_m2", "bldg_area_m2"), part("resid_area", "resid_bldg_area_m2"),
        part("comm_area", "commercial_bldg_area_m2"), part("_units", "_hu"), part("_pop", "_po"))
    d = cells.join(cell, ["row_", "col_"], "left").join(per, "zone", "left").join(z, "zone", "left")
    fallback = F.col("bg_resid_bldg_area_m2").isNull() | (F.col("bg_resid_bldg_area_m2") <= 0)
    share = step * step * F.col("land_frac") / F.when(F.col("ALAND") != 0, F.col("ALAND"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.withColumns({
        "bldg_count": F.coalesce("bldg_count", F.lit(0)),
        **{c: zero(c) for c in ("bldg_area_m2", "resid_bldg_area_m2", "commercial_bldg_area_m2")},
        "exposure_fallback": fallback,
        "housing_units_bldg": F.when(fallback, F.col("housing_units") * share).otherwise(zero("_hu")),
        "pop_bldg": F.when(fallback, F.col("population") * share).otherwise(zero("_po"))}).drop("_hu", "_po")


def bldg_per_cell(buildings: DataFrame, left: float, top: float, step: float, ncol: int, nrow: int) -> DataFrame:
    from panelwright.operators.tables import grid_bin
    b = grid_bin(G.with_representative_point(buildings), F.col("px"), F.col("py"), left, top, step, ncol, nrow)
    home = F.col("bldg_class") == "residential"
    return b.groupBy("cell").agg(F.count_if(home).alias("n_doors"), F.count("*").alias("n_struct"),
                                 F.sum(F.when(home, F.col("area_m2")).otherwise(0.0)).alias("resid_area"))


def sample_line(lines: DataFrame, n: Column, at: Column, line: str = "line") -> DataFrame:
    """``n`` points per line; ``at(i, n)`` is given as a Column over ``_i`` and ``_n`` of the length share."""
    d = G.pin(lines, _len=G.line_length(F.col(line))).withColumn("_n", n)
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = G.pin(d, _at=at * F.col("_len"))
    d = G.pin(d, _p=G.at_distance(F.col(line), F.col("_at"))).drop("_at")
    return d.withColumns({"px": F.col("_p.x"), "py": F.col("_p.y")}).drop("_p")


def midpoints(lines: DataFrame, step: float) -> DataFrame:
    """Interior points every ``step``: ceil(length/step) of them, each carrying an equal share."""
    n = F.greatest(F.ceil(F.col("_len") / step).cast("int"), F.lit(1))
    return sample_line(lines, n, (F.col("_i") + 0.5) / F.col("_n")).withColumn("share", 1 / F.col("_n"))


def line_apportion(lines: DataFrame, segs: DataFrame, value: str, max_dist: float = 25.0, step: float = 10.0,
                   key: str = "line_id") -> DataFrame:
    """Split a per-line value over the segments its samples land on; one match per sample keeps the total."""
    s = midpoints(lines, step).withColumn("_sid", F.struct(F.col(key), F.col("_i")))
    s = s.select("_sid", "px", "py", (F.col(value) * F.col("share")).alias("_v"), (F.col("_len") * F.col("share")).alias("_m"))
    j = nearest_line_join(s, segs, max_dist, key="_sid").where("seg_id is not null")
    return j.groupBy("seg_id").agg(F.sum("_v").alias("value"), F.sum("_m").alias("matched_len_m"))


def count_points(points: DataFrame, segs: DataFrame, max_dist: float, sums: dict[str, Column], key: str = "id") -> DataFrame:
    j = nearest_line_join(points, segs, max_dist, key=key).where("seg_id is not null")
    return j.groupBy("seg_id").agg(*[c.alias(n) for n, c in sums.items()])


def ring_front_join(buildings: DataFrame, segs: DataFrame, max_dist: float, key: str = "b") -> DataFrame:
    """Nearest segment to a footprint's wall (not its middle) within ``max_dist``."""
    size = 4.0 * max_dist
    # both lie in few bytes, so one task would work on the boxes of them all
    closed = buildings.select(key, "ring").repartition(key).select(key, G.close_ring(F.col("ring")).alias("_a"))
    s = segs.select("seg_id", F.col("line").alias("_b")).repartition("seg_id")
    first = F.element_at("_b", 1)
    d = F.when(G.in_ring(first["x"], first["y"], F.col("_a")), 0.0).otherwise(G.line_line_distance(F.col("_a"), F.col("_b")))
    j = boxes_within(closed, s, "_a", "_b", max_dist, size, key).withColumn("_d", d).where(F.col("_d") <= max_dist)
    best = j.groupBy(key).agg(F.min(F.struct(F.col("_d").alias("snap_m"), F.col("seg_id"))).alias("_m"))
    return buildings.join(best.select(key, "_m.seg_id", "_m.snap_m").hint("merge"), key, "left")


def target_counts(segs: DataFrame, addresses: DataFrame, parcels: DataFrame, buildings: DataFrame,
                  point_m: float = 60.0, front_m: float = 15.0, entrances: DataFrame | None = None, entrance_m: float = 30.0) -> DataFrame:
    """Street-facing targets per segment: doors, address units, parcels, fronting buildings and, if given, mapped entrances."""
    from panelwright.operators.tables import join_many_outer
    one = addresses.groupBy("addr").agg(F.min_by(F.struct("id", "px", "py"), "id").alias("_m")).select("_m.*")
    doors = count_points(one, segs, point_m, {"front_doors": F.count("*")})
    units = count_points(addresses, segs, point_m, {"addr_units": F.count("*")})
    lots = count_points(parcels, segs, point_m, {"parcel_n": F.count("*"), "resunits": F.sum("units"),
                                                 "retail_sqft": F.sum("retail"), "garage_parcels": F.sum("garage")})
    front = ring_front_join(buildings, segs, front_m).where("seg_id is not null").groupBy("seg_id").agg(
        F.count("*").alias("bldg_front"), F.count_if(F.lower("bldg_class").contains("resid")).alias("bldg_front_resid"))
    ways = [] if entrances is None else [count_points(entrances, segs, entrance_m, {"osm_entrances": F.count("*")})]
    return join_many_outer([doors, units, lots, front, *ways], "seg_id")


def line_length_in_disk(query: DataFrame, lines: DataFrame, r: float, spacing: float = 20.0, key: str = "id",
                        out: str = "len_m") -> DataFrame:
    """Street metres within r: lines sampled at even spacing, each sample carrying its share of length."""
    n = F.greatest(F.rint(F.col("_len") / spacing).cast("int"), F.lit(1))
    p = sample_line(lines, n, (F.col("_i") + 0.5) / F.col("_n"))
    p = p.select(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("_len") / F.col("_n")).alias("w"))
    return radius_sum(query, p, r, F.col("w"), key, out)


def segment_mean_of_samples(lines: DataFrame, pixels: DataFrame, left: float, top: float, cell: float,
                            value: str = "z", spacing: float = 20.0, seg: str = "seg_id") -> DataFrame:
    """Means of every raster along each line, end to end at even spacing, null pixels ignored.

    One row a line and raster that it meets; a line that meets none has one row of nulls.
    """
    n = F.greatest(F.rint(F.col("_len") / spacing).cast("int") + 1, F.lit(2))
    p = sample_line(lines, n, F.col("_i") / (F.col("_n") - 1))
    p = p.select(seg, F.floor((F.col("px") - left) / cell).cast("int").alias("col"), F.floor((top - F.col("py")) / cell).cast("int").alias("row"))
    m = p.join(pixels.select("raster_id", "row", "col", value), ["row", "col"]).groupBy(seg, "raster_id").agg(F.avg(value).alias(value))
    return lines.join(m, seg, "left")


def subset_by_place(points: DataFrame, places: DataFrame, name: str, size: float, key: str = "id") -> DataFrame:
    """Points inside the largest of the places sharing a name."""
    best = places.where(F.col("place_name") == name).agg(F.max_by(F.struct("zone", "ring"), F.struct("aland", "zone")).alias("_m")).select("_m.*")
    return pip_join(points, best, size, key=key, how="inner")
