"""Coordinates: longitude and latitude to UTM and back by Krueger's series (Karney 2011), as column expressions.

Order is always (longitude, latitude) = (x, y). EPSG 326zz / 258zz north, 327zz south; 4326 geographic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
E = (FLAT * (2 - FLAT)) ** 0.5
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def zone(epsg: int) -> tuple[int, bool]:
    """(zone, south) of a UTM code."""
    group, z = divmod(epsg, 100)
    if group not in (326, 327, 258) or not 1 <= z <= 60:
        raise ValueError(f"EPSG:{epsg} is not a UTM code known here")
    return z, group == 327


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    z, south = zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - (6.0 * z - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * RADIUS * x, (SOUTH if south else 0.0) + SCALE * RADIUS * y


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    z, south = zone(epsg)
    xi, eta = (y - (SOUTH if south else 0.0)) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    u, v = xi, eta
    for k, b in enumerate(BETA, 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for k, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return 6.0 * z - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between two codes; equal codes leave the columns as they are."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else from_utm(x, y, source)
    return (lon, lat) if target == 4326 else to_utm(lon, lat, target)


def same(a: int | None, b: int | None) -> bool:
    """Known and equal; two unknown systems are not the same."""
    return a is not None and a == b


def from_geokeys(keys: Column) -> Column:
    """EPSG code from a map of GeoTIFF keys: projected code first, then geographic; null for user-defined ones."""
    def code(name: str) -> Column:
        v = F.try_element_at(keys, F.lit(name)).cast("int")
        return F.when(v.between(1024, 32766), v)

    return F.coalesce(code("ProjectedCSTypeGeoKey"), code("GeographicTypeGeoKey"))
