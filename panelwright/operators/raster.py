"""Focal, zonal and resampling operators on pixel tables (raster_id, row, col, z).

A raster is cut into square tiles, each carrying a rim of its neighbours'
pixels as wide as the operator looks.  One shuffle by tile then serves every
window of the operator (by row and by column), and no task ever holds more
than one tile with its rim, whatever the raster's size.  Short-range operators
are native windows; long-range ones work on the tile as an array.
Invalid pixels are rows with NULL z; the grid is dense.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.stats import norm_cdf
from panelwright.functions.terrain import COST_POLY
from panelwright.operators.ranks import exact_percentiles

TILE = 256
NATIVE_REACH = 12
KEYS = ["raster_id", "_tr", "_tc"]


def tiles(px: DataFrame, rim: int, tile: int = TILE) -> DataFrame:
    """Pixels repeated into every tile that needs them, shuffled once by tile."""
    d = px
    for k, v in (("_tr", "row"), ("_tc", "col")):
        low = F.greatest(F.floor((F.col(v) - rim) / tile), F.lit(0)).cast("int")
        d = d.withColumn(k, F.explode(F.sequence(low, F.floor((F.col(v) + rim) / tile).cast("int"))))
    return d.repartition(*KEYS)


def interior(d: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop the rims again."""
    own = (F.floor(F.col("row") / tile) == F.col("_tr")) & (F.floor(F.col("col") / tile) == F.col("_tc"))
    return d.where(own).drop("_tr", "_tc")


def by_row():
    return Window.partitionBy(*KEYS, "row").orderBy("col")


def by_col():
    return Window.partitionBy(*KEYS, "col").orderBy("row")


def _slope_along(w, pos: str, cell: float) -> Column:
    """Central difference inside, one-sided at the raster's edge; a null neighbour gives null."""
    prev, nxt = F.lag("z").over(w), F.lead("z").over(w)
    has_prev, has_next = F.lag(pos).over(w).isNotNull(), F.lead(pos).over(w).isNotNull()
    return (F.when(has_prev & has_next, (nxt - prev) / (2.0 * cell))
             .when(has_next, (nxt - F.col("z")) / cell)
             .when(has_prev, (F.col("z") - prev) / cell))


def gradients(px: DataFrame, cell: float, tile: int = TILE) -> DataFrame:
    d = tiles(px, 1, tile)
    d = d.withColumn("gx", _slope_along(by_row(), "col", cell)).withColumn("gy", _slope_along(by_col(), "row", cell))
    return interior(d, tile)


def slope_deg(px: DataFrame, cell: float, tile: int = TILE) -> DataFrame:
    d = gradients(px, cell, tile)
    s = F.degrees(F.atan(F.hypot("gx", "gy")))
    return d.withColumn("slope_deg", F.when(F.col("z").isNotNull(), s)).drop("gx", "gy")


def hillshade(px: DataFrame, cell: float, azimuth: float = 315.0, altitude: float = 45.0, zfactor: float = 1.5,
              tile: int = TILE) -> DataFrame:
    d = gradients(px, cell, tile)
    # light vector against the surface normal (-gx', gy', 1), rows running down
    az, alt = math.radians(azimuth), math.radians(altitude)
    gx, gy = F.col("gx") * zfactor, F.col("gy") * zfactor
    v = (math.sin(alt) + math.cos(alt) * (math.sin(az) * gy - math.cos(az) * gx)) / F.sqrt(1.0 + gx * gx + gy * gy)
    # greatest and least skip nulls, so an unshadable pixel is kept null explicitly
    return d.withColumn("shade", F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))).drop("gx", "gy")


def local_relief(px: DataFrame, radius: float, cell: float, out: str = "relief", tile: int = TILE) -> DataFrame:
    """Max minus min over a square window, in two one-dimensional passes."""
    k = int(math.ceil(radius / cell))
    d = tiles(px, k, tile)
    rw, cw = by_row().rowsBetween(-k, k), by_col().rowsBetween(-k, k)
    d = d.withColumns({"_hi": F.max("z").over(rw), "_lo": F.min("z").over(rw)})
    d = d.withColumns({"_hi": F.max("_hi").over(cw), "_lo": F.min("_lo").over(cw)})
    return interior(d.withColumn(out, F.when(F.col("z").isNotNull(), F.col("_hi") - F.col("_lo"))).drop("_hi", "_lo"), tile)


def _disk_widths(radius_px: float) -> list[int]:
    return [int(math.floor(math.sqrt(radius_px * radius_px - dy * dy))) for dy in range(int(math.floor(radius_px)) + 1)]


def focal_moments(px: DataFrame, radius: float, cell: float, tile: int = TILE) -> DataFrame:
    """Count, mean and sd of valid pixels in a disk: columns fn, fmean, fsd."""
    r = radius / cell
    widths = _disk_widths(r)
    reach = len(widths) - 1
    if reach > NATIVE_REACH:
        return tile_apply(px, reach, _disk_moments(r), ["fn", "fmean", "fsd"], tile)
    d = tiles(px, reach, tile)
    cum, whole = by_row().rowsBetween(Window.unboundedPreceding, 0), by_row().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    z = F.coalesce("z", F.lit(0.0))
    base = {"n": F.when(F.col("z").isNotNull(), 1.0).otherwise(0.0), "s": z, "q": z * z}
    d = d.withColumns({f"_c{m}": F.sum(v).over(cum) for m, v in base.items()})
    strip = {}
    for w in sorted(set(widths)):
        for m in base:
            right = F.coalesce(F.lead(f"_c{m}", w).over(by_row()), F.last(f"_c{m}").over(whole))
            left = F.coalesce(F.lag(f"_c{m}", w + 1).over(by_row()), F.lit(0.0))
            strip[f"_t{w}{m}"] = right - left
    d = d.withColumns(strip)
    total = {}
    for m in base:
        acc = F.col(f"_t{widths[0]}{m}")
        for dy in range(1, reach + 1):
            c = f"_t{widths[dy]}{m}"
            acc = acc + F.coalesce(F.lag(c, dy).over(by_col()), F.lit(0.0)) + F.coalesce(F.lead(c, dy).over(by_col()), F.lit(0.0))
        total[f"_s{m}"] = acc
    d = d.withColumns(total)
    n = F.greatest("_sn", F.lit(1e-6))
    mean = F.col("_ss") / n
    var = F.greatest(F.col("_sq") / n - mean * mean, F.lit(0.0))
    d = d.withColumns({"fn": F.col("_sn"), "fmean": mean, "fsd": F.sqrt(var)})
    return interior(d.select(*px.columns, "_tr", "_tc", "fn", "fmean", "fsd"), tile)


def tpi(px: DataFrame, radius: float, cell: float, tile: int = TILE) -> DataFrame:
    """Height above the local mean, standardised height and Gaussian height percentile."""
    d = focal_moments(px, radius, cell, tile)
    ok = F.col("z").isNotNull() & (F.col("fn") > 3)
    d = d.withColumns({"tpi": F.when(ok, F.col("z") - F.col("fmean")),
                       "tpiz": F.when(ok & (F.col("fsd") > 1e-3), (F.col("z") - F.col("fmean")) / F.col("fsd"))})
    return d.withColumn("pctl", norm_cdf(F.col("tpiz"))).drop("fn", "fmean", "fsd")


# ---- long-range operators: one bounded array per tile ---------------------------------
def tile_apply(px: DataFrame, rim: int, fn, out: list[str], tile: int = TILE) -> DataFrame:
    """Run ``fn(z) -> [arrays]`` on each tile-with-rim as a float array (NaN = invalid or absent).

    A group is one tile with its rim: at most (tile + 2 rim)^2 pixels.
    """
    types = dict(px.dtypes)
    schema = f"raster_id {types['raster_id']}, row int, col int, z double, " + ", ".join(f"{c} double" for c in out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = pdf["z"].to_numpy(dtype=float)
        fields = fn(z)
        own = ((pdf["row"] // tile == pdf["_tr"]) & (pdf["col"] // tile == pdf["_tc"])).to_numpy()
        res = pdf.loc[own, ["raster_id", "row", "col", "z"]].copy()
        for name, a in zip(out, fields):
            v = a[r[own], c[own]]
            res[name] = np.where(np.isfinite(v), v, np.nan)
        return res

    d = tiles(px.select("raster_id", "row", "col", "z"), rim, tile).groupBy(*KEYS).applyInPandas(run, schema)
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return d.withColumns({c: null(c) for c in ["z", *out]})


def _disk_moments(r: float):
    widths = _disk_widths(r)

    def run(z):
        ok = np.isfinite(z)
        rows, cols = z.shape
        parts = []
        for a in (ok.astype(float), np.where(ok, z, 0.0), np.where(ok, z, 0.0) ** 2):
            cum = np.concatenate([np.zeros((rows, 1)), np.cumsum(a, axis=1)], axis=1)
            tot = np.zeros_like(a)
            at = np.arange(cols)
            for dy in range(-len(widths) + 1, len(widths)):
                w = widths[abs(dy)]
                strip = cum[:, np.minimum(at + w + 1, cols)] - cum[:, np.maximum(at - w, 0)]
                lo, hi = max(0, -dy), min(rows, rows - dy)
                if lo >= hi:
                    continue
                tot[lo:hi] += strip[lo + dy:hi + dy]
            parts.append(tot)
        n, s, q = parts
        n = np.maximum(n, 1e-6)
        mean = s / n
        return [parts[0], mean, np.sqrt(np.maximum(q / n - mean * mean, 0))]
    return run


def catchment(radius: float, cell: float, n_dirs: int, n_rings: int, decay_m: float | None = None) -> pd.DataFrame:
    """The pixels that spokes meet on evenly spaced rings, each once: dx, dy, how often met, summed weight.

    A ring weighs its radius, less with distance under ``decay_m``; the centre is left out.
    """
    ring = radius * np.arange(1, n_rings + 1) / n_rings
    turn = 2.0 * np.pi * np.arange(n_dirs) / n_dirs
    met = pd.DataFrame({"dx": np.rint(np.outer(ring, np.cos(turn)) / cell).astype(int).ravel(),
                        "dy": np.rint(np.outer(ring, np.sin(turn)) / cell).astype(int).ravel(),
                        "weight": np.repeat(ring * np.exp(-ring / decay_m) if decay_m else ring, n_dirs)})
    met = met[(met["dx"] != 0) | (met["dy"] != 0)]
    return met.groupby(["dx", "dy"], as_index=False).agg(met=("weight", "size"), weight=("weight", "sum"))


def _reach(at: pd.DataFrame) -> int:
    return int(at[["dx", "dy"]].abs().to_numpy().max())


def _neighbours(z: np.ndarray, at: pd.DataFrame):
    """For each offset its row of ``at`` and a view of the once padded tile: the pixel dy rows up and dx columns left."""
    r = _reach(at)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(z, r, constant_values=np.nan), z.shape)
    for o in at.itertuples():
        yield o, views[r - o.dy, r - o.dx]


def round_trip_cost(px: DataFrame, cell: float, radius: float, loot_kg: float, body_kg: float = 75.0, n_dirs: int = 48,
                    n_rings: int = 6, decay_m: float | None = None, out: str = "rtc", tile: int = TILE) -> DataFrame:
    """Ring-weighted mean cost of walking in unladen and out with a load, over the catchment."""
    return costs(px, cell, radius, {out: loot_kg}, body_kg, n_dirs, n_rings, decay_m, tile)


def costs(px: DataFrame, cell: float, radius: float, loads: dict[str, float], body_kg: float = 75.0, n_dirs: int = 48,
          n_rings: int = 6, decay_m: float | None = None, tile: int = TILE) -> DataFrame:
    """Round-trip cost for several loads in one pass over the offsets."""
    at = catchment(radius, cell, n_dirs, n_rings, decay_m)
    even, odd = COST_POLY[::-1][0::2], COST_POLY[::-1][1::2]

    def run(z):
        # cost(g) + f cost(-g) = (1 + f) even(g) + (1 - f) odd(g): the sums serve every load
        both, tilt, weight = np.zeros(z.shape), np.zeros(z.shape), np.zeros(z.shape)
        for o, n in _neighbours(z, at):
            d = cell * math.hypot(o.dx, o.dy)
            g = np.clip((z - n) / d, -0.5, 0.5)
            ok, sq = np.isfinite(g), g * g
            weight += ok * o.weight
            both += np.where(ok, np.polynomial.polynomial.polyval(sq, even) * (d * o.weight), 0.0)
            tilt += np.where(ok, np.polynomial.polynomial.polyval(sq, odd) * g * (d * o.weight), 0.0)
        weight[(weight == 0) | np.isnan(z)] = np.nan
        share = [(body_kg + kg) / body_kg for kg in loads.values()]
        return [((1.0 + f) * both + (1.0 - f) * tilt) / weight for f in share]

    return tile_apply(px, _reach(at), run, list(loads), tile)


def loot_penalty(px: DataFrame, cell: float, radius: float, heavy_kg: float = 20.0, light_kg: float = 0.3, **kw) -> DataFrame:
    d = costs(px, cell, radius, {"rtc_heavy": heavy_kg, "rtc_light": light_kg}, **kw)
    return d.withColumn("loot_penalty", F.col("rtc_heavy") - F.col("rtc_light"))


def viewshed_share(px: DataFrame, cell: float, radius: float = 500.0, n_dirs: int = 36, n_rings: int = 10, tile: int = TILE) -> DataFrame:
    """Share of the sampled surroundings that lies lower; invalid neighbours count in neither part."""
    at = catchment(radius, cell, n_dirs, n_rings)

    def run(z):
        lower, seen = np.zeros(z.shape), np.zeros(z.shape)
        for o, n in _neighbours(z, at):
            lower += o.met * (z > n)
            seen += o.met * np.isfinite(z - n)
        return [lower / np.where(seen > 0, seen, np.nan)]

    return tile_apply(px, _reach(at), run, ["viewshed"], tile)


# ---- blocks and cells -----------------------------------------------------------------
def block_agg(px: DataFrame, f: int, values: list[str], how: str = "avg") -> DataFrame:
    """Aggregate whole f x f blocks; trailing partial blocks are dropped; land_frac is the valid share."""
    size = px.groupBy("raster_id").agg((F.floor((F.max("row") + 1) / f)).alias("_h"), (F.floor((F.max("col") + 1) / f)).alias("_w"))
    d = px.withColumns({"brow": F.floor(F.col("row") / f).cast("int"), "bcol": F.floor(F.col("col") / f).cast("int")})
    agg = {"avg": F.avg, "max": F.max}[how]
    g = d.groupBy("raster_id", "brow", "bcol").agg(*[agg(v).alias(v) for v in values],
                                                  F.avg(F.when(F.col("z").isNotNull(), 1.0).otherwise(0.0)).alias("land_frac"))
    return g.join(size, "raster_id").where("brow < _h and bcol < _w").withColumn("ncol", F.col("_w").cast("int")).drop("_h", "_w")


def cell_centroids(blocks: DataFrame, left: float, top: float, cell: float, f: int) -> DataFrame:
    step = f * cell
    return blocks.withColumns({"cell": (F.col("brow") * F.col("ncol") + F.col("bcol")).cast("bigint"),
                               "x": left + (F.col("bcol") + 0.5) * step, "y": top - (F.col("brow") + 0.5) * step})


def resample_to_cells(px: DataFrame, value: str, left: float, top: float, cell: float, cells: DataFrame, cell_m: float = 100.0) -> DataFrame:
    """Mean of pixels of any size inside each cell, matched by index arithmetic.

    Grid origins come from the cells' own extent per raster.
    """
    ext = cells.groupBy("raster_id").agg((F.min("x") - cell_m / 2).alias("_l"), (F.max("y") + cell_m / 2).alias("_t"))
    at = lambda d, x, y: d.join(ext, "raster_id").withColumns({"_gx": F.floor((x - F.col("_l")) / cell_m), "_gy": F.floor((F.col("_t") - y) / cell_m)}).drop("_l", "_t")
    p = at(px.where(F.col(value).isNotNull()), left + (F.col("col") + 0.5) * cell, top - (F.col("row") + 0.5) * cell)
    m = p.groupBy("raster_id", "_gx", "_gy").agg(F.avg(value).alias(value))
    return at(cells, F.col("x"), F.col("y")).join(m, ["raster_id", "_gx", "_gy"], "left").drop("_gx", "_gy")


def resolution_compare(wide: DataFrame, columns: list[str], ref: str) -> DataFrame:
    """Each source's spread, and its regression on and correlation with the reference source."""
    arms = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("v"), F.col(ref).alias("r")) for c in columns])
    long = wide.select(F.explode(arms).alias("_a")).select("_a.*").where("v is not null and r is not null")
    g = long.groupBy("source").agg(
        F.avg("v").alias("mean_deg"), F.stddev_samp("v").alias("sd_deg"), F.max("v").alias("max_deg"),
        F.regr_intercept("v", "r").alias("vs_intercept"), F.regr_slope("v", "r").alias("vs_slope"),
        F.regr_r2("v", "r").alias("vs_r2"), F.corr("v", "r").alias("corr_with_ref"))
    return g.join(exact_percentiles(long, ["source"], "v", [0.1, 0.5, 0.9], ["p10_deg", "p50_deg", "p90_deg"]), "source")
