"""Column functions on coordinates: UTM zones and projection, boxes, polygons, road distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.functions.bind import let

# WGS 84 and the UTM grid
_A, _FLAT, _K0, _FALSE_E, _FALSE_N = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krüger series in the third flattening
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Code of the UTM zone holding a point; null outside the valid range."""
    zone = (F.floor((lon + 180.0) / 6.0) % 60 + 1).cast("int")
    return F.when(
        lon.between(-180, 180) & lat.between(-90, 90), zone + F.when(lat >= 0, 32600).otherwise(32700)
    )


def is_utm(epsg: Column) -> Column:
    """Whether a code is a UTM zone, north or south."""
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def _central(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """``struct<x,y>`` in metres."""
    south = F.when(epsg >= 32700, _FALSE_N).otherwise(0.0)
    phi, lam = F.radians(lat), F.radians(lon) - _central(epsg)

    def series(q: Column) -> Column:
        x, y = q["eta"], q["xi"]
        for j, a in enumerate(_ALPHA, 1):
            x = x + F.lit(a) * F.cos(2 * j * q["xi"]) * F.sinh(2 * j * q["eta"])
            y = y + F.lit(a) * F.sin(2 * j * q["xi"]) * F.cosh(2 * j * q["eta"])
        k = F.lit(_K0 * _RECT)
        return F.struct((k * x + _FALSE_E).alias("x"), (k * y + south).alias("y"))

    def sphere(t: Column) -> Column:
        xi = F.atan2(t, F.cos(lam))
        eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        return let(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    return let(F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi))), sphere)


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """``struct<lon,lat>`` in degrees."""
    south = F.when(epsg >= 32700, _FALSE_N).otherwise(0.0)
    xi, eta = (y - south) / F.lit(_K0 * _RECT), (x - _FALSE_E) / F.lit(_K0 * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = _central(epsg) + F.atan2(F.sinh(v), F.cos(u))
    return F.struct(F.degrees(lam).alias("lon"), F.degrees(phi).alias("lat"))


def shoelace(ring: Column) -> Column:
    """Area of a ring given as an array of ``struct<x,y>``, closed or not."""
    n = F.size(ring)
    twice = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + (ring[i]["x"] * ring[((i + 1) % n).cast("int")]["y"] - ring[((i + 1) % n).cast("int")]["x"] * ring[i]["y"]),
    )
    return F.abs(twice) / 2


def centroid(ring: Column) -> Column:
    """``struct<x,y>`` centroid of a ring; the vertex mean where it has no area."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        p, q = ring[i], ring[((i + 1) % n).cast("int")]
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["x"] + (p["x"] + q["x"]) * cross).alias("x"),
            (acc["y"] + (p["y"] + q["y"]) * cross).alias("y"),
        )

    def mean(axis: str) -> Column:
        return F.aggregate(F.transform(ring, lambda p: p[axis]), F.lit(0.0), lambda a, b: a + b) / n

    s = F.aggregate(F.sequence(F.lit(0), n - 1), zero, add)
    return F.struct(
        F.when(F.abs(s["a"]) > 1e-12, s["x"] / (3 * s["a"])).otherwise(mean("x")).alias("x"),
        F.when(F.abs(s["a"]) > 1e-12, s["y"] / (3 * s["a"])).otherwise(mean("y")).alias("y"),
    )


def box_facts(west: Column, south: Column, east: Column, north: Column, cell: float) -> Column:
    """``struct<epsg,x_min,y_max,rows,cols,area_km2>`` of a lon/lat box in its own zone."""
    def measure(q: Column) -> Column:
        xs, ys = [q[i]["x"] for i in range(4)], [q[i]["y"] for i in range(4)]
        area = F.lit(0.0)
        for i in range(4):
            j = (i + 1) % 4
            area = area + (xs[i] * ys[j] - xs[j] * ys[i])
        return F.struct(
            epsg.alias("epsg"),
            F.least(*xs).alias("x_min"),
            F.greatest(*ys).alias("y_max"),
            F.ceil((F.greatest(*ys) - F.least(*ys)) / cell).cast("long").alias("rows"),
            F.ceil((F.greatest(*xs) - F.least(*xs)) / cell).cast("long").alias("cols"),
            (F.abs(area) / 2 / 1e6).alias("area_km2"),
        )

    epsg = utm_epsg((west + east) / 2, (south + north) / 2)
    corners = ((west, south), (east, south), (east, north), (west, north))
    return let(F.array(*[to_utm(a, b, epsg) for a, b in corners]), measure)


def cell_of(x: Column, y: Column, x_min: Column, y_max: Column, cell: Column) -> Column:
    """``struct<row,col>`` of the cell holding a point; rows run north to south."""
    return F.struct(
        F.floor((y_max - y) / cell).alias("row"), F.floor((x - x_min) / cell).alias("col")
    )


def cell_centre(row: Column, col: Column, x_min: Column, y_max: Column, cell: Column) -> Column:
    """``struct<x,y>`` of a cell's centre."""
    return F.struct((x_min + (col + 0.5) * cell).alias("x"), (y_max - (row + 0.5) * cell).alias("y"))


def resolution(spacing: Column, floor_m: float, cap_m: float, per_spacing: float = 4.0) -> Column:
    """Cell size from contour spacing, kept within limits."""
    return F.least(F.greatest(spacing / per_spacing, F.lit(float(floor_m))), F.lit(float(cap_m)))


def grid_node(lat: Column, lon: Column, n: Column) -> Column:
    """Nearest node of an ``n × n`` unit grid; points outside go to the border."""

    def at(v: Column) -> Column:
        return F.least(F.greatest(F.floor(v * (n - 1) + 0.5), F.lit(0)), n - 1)

    return (at(lat) * n + at(lon)).cast("long")
