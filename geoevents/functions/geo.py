"""Geometry expressions without a geometry engine: projection, distances, cells, areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_KM = 6_371.0
SPHERE_M = 6_378_137.0

# Ellipsoid and zone of the metric system (GRS80, transverse Mercator zone 23 south).
_A = 6_378_137.0
_F = 1 / 298.257222101
_K0 = 0.9996
_E0 = 500_000.0
_N0 = 10_000_000.0
_LON0 = -45.0

_n = _F / (2 - _F)
_RADIUS = _K0 * _A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
_ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
_BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
_DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)
_ECC = 2 * math.sqrt(_n) / (1 + _n)


def _series(xi: Column, eta: Column) -> tuple[Column, Column]:
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        y = y + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    return F.lit(_E0) + F.lit(_RADIUS) * x, F.lit(_N0) + F.lit(_RADIUS) * y


def _tan_chi(s: Column) -> Column:
    return F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))


def _sphere(t: Column, lon: Column) -> tuple[Column, Column]:
    dl = F.radians(lon - F.lit(_LON0))
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))


def project_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres by the Krüger series (error far below a millimetre in the zone)."""
    return _series(*_sphere(_tan_chi(F.sin(F.radians(lat))), lon))


def unproject_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees from metric coordinates."""
    xi = (y - F.lit(_N0)) / F.lit(_RADIUS)
    eta = (x - F.lit(_E0)) / F.lit(_RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
        eta1 = eta1 - F.lit(b) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(chi * (2.0 * j))
    lon = F.lit(_LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.degrees(phi), lon


def with_metric(df, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y"):
    """Add projected columns, step by step: shared terms stay columns, so each is computed once
    and later joins on x, y do not carry the whole series in their conditions."""
    steps = df.withColumn("_t", _tan_chi(F.sin(F.radians(F.col(lat)))))
    xi, eta = _sphere(F.col("_t"), F.col(lon))
    steps = steps.withColumns({"_xi": xi, "_eta": eta})
    px, py = _series(F.col("_xi"), F.col("_eta"))
    return steps.withColumns({x: px, y: py}).drop("_t", "_xi", "_eta")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon
    ) * F.sin(dlon)
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def dist2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def within(x1: Column, y1: Column, x2: Column, y2: Column, radius: float) -> Column:
    """Is the distance at most the radius?  False, not NULL, for missing coordinates (see ``cell``)."""
    return F.coalesce(dist2(x1, y1, x2, y2) <= F.lit(float(radius) ** 2), F.lit(False))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(dist2(x1, y1, x2, y2))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


# Cell index of a missing coordinate: a cell no place lies in.
NO_CELL = -(1 << 62)


def cell(c: Column, size: float) -> Column:
    """Grid index of a coordinate. Never NULL: a NULL join key would make Spark test the whole
    coordinate expression for NULL in a filter pushed below the projection."""
    return F.coalesce(F.floor(c / F.lit(float(size))).cast("bigint"), F.lit(NO_CELL))


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Edge crosses the ray going right from the point (half-open in y)."""
    straddles = (y1 > py) != (y2 > py)
    return straddles & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1))


def radius_circle(lat: Column, lon: Column, radius_m: float, steps: int = 64) -> Column:
    """Closed ring of steps + 1 (lon, lat) vertices around a point."""
    lat_r = F.lit(radius_m / 111_320.0)
    lon_r = F.lit(radius_m) / (F.lit(111_320.0) * F.cos(lat * F.lit(math.pi) / F.lit(180.0)))

    def vertex(i: Column) -> Column:
        theta = i.cast("double") / F.lit(float(steps)) * F.lit(2 * math.pi)
        return F.struct(
            (lon + lon_r * F.cos(theta)).alias("lon"), (lat + lat_r * F.sin(theta)).alias("lat")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(v·10^d + 0.5)/10^d, the rounding of the query layer."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
