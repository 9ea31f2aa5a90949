"""Map arithmetic as Columns: UTM zone and projection, box padding, web-map tiles, quadkeys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111000.0
# WGS84 ellipsoid and UTM constants (published values)
_A, _F, _K0, _E0, _N0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = _F / (2 - _F)
RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
ECC = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, utm_zone(lon) + 32600).otherwise(utm_zone(lon) + 32700)


def _atanh(v: Column) -> Column:
    return F.lit(0.5) * F.log((1 + v) / (1 - v))


def _series(xi: Column, eta: Column, south: Column) -> Column:
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.when(south, F.lit(_N0)).otherwise(F.lit(0.0))
    return F.struct((_E0 + _K0 * RECTIFYING * east).alias("x"),
                    (shift + _K0 * RECTIFYING * north).alias("y"))


def project_utm(df: DataFrame, lon: str = "lon", lat: str = "lat", out: tuple = ("ux", "uy"),
                zone: Column | None = None) -> DataFrame:
    """Forward transverse Mercator by the Krueger series to fourth order, in metres.

    ``zone`` pins all points of a city to one zone; by default each point's own.
    The series is exploded from a one-element array: a generator is a barrier,
    so later filters on x and y are not rewritten into copies of the formula.
    """
    zone = utm_zone(F.col(lon)) if zone is None else zone
    d = df.withColumn("_s", F.sin(F.radians(lat))).withColumn(
        "_lam", F.radians(F.col(lon) - (zone * 6 - 183)))
    d = d.withColumn("_t", F.sinh(_atanh(F.col("_s")) - ECC * _atanh(ECC * F.col("_s"))))
    d = d.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_lam"))).withColumn(
        "_eta", _atanh(F.sin("_lam") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    xy = _series(F.col("_xi"), F.col("_eta"), F.col(lat) < 0)
    d = d.select(*df.columns, F.explode(F.array(xy)).alias("_xy"))
    return d.select(*df.columns, F.col("_xy.x").alias(out[0]), F.col("_xy.y").alias(out[1]))


def pad_bbox(w: Column, s: Column, e: Column, n: Column, metres: float):
    dlat = F.lit(metres / METRES_PER_DEGREE)
    dlon = F.lit(metres) / (METRES_PER_DEGREE * F.cos(F.radians((s + n) / 2)))
    return w - dlon, s - dlat, e + dlon, n + dlat


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    r = F.radians(lat)
    x = ((lon + 180.0) / 360.0 * n).cast("int")
    y = ((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).cast("int")
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    return clamp(x), clamp(y)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Interleave the tile's bits, most significant first, into base-4 digits."""
    digits = []
    for bit in range(zoom - 1, -1, -1):
        mx = F.shiftright(x, bit).bitwiseAND(F.lit(1))
        my = F.shiftright(y, bit).bitwiseAND(F.lit(1))
        digits.append((mx + 2 * my).cast("string"))
    return F.concat(*digits)


def tiles_of_bbox(w: Column, s: Column, e: Column, n: Column, zoom: int) -> Column:
    """Array of quadkeys of every tile touching a lon/lat box (for one explode)."""
    x0, y0 = tile_xy(w, n, zoom)
    x1, y1 = tile_xy(e, s, zoom)
    return F.flatten(F.transform(
        F.sequence(x0, x1),
        lambda x: F.transform(F.sequence(y0, y1), lambda y: quadkey(x, y, zoom)),
    ))
