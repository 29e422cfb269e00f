"""Column functions for an excavated pond: frustum geometry, sizing, spillway."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.functions.bind import let

MIN_BOTTOM_M = 5.0
#: Unit rates per m3 and storage limits of a village pond.
EXCAVATION_RATE, EMBANKMENT_RATE = 160.0, 220.0
MIN_STORAGE_M3, MAX_STORAGE_M3 = 2_000.0, 50_000.0
HARVEST_EFFICIENCY, DEAD_STORAGE = 0.6, 0.15


def bottom(side: Column, depth: Column, slope: float) -> Column:
    """Bottom dimension: the top inset by the side slopes."""
    return side - 2 * slope * depth


def feasible(length: Column, width: Column, depth: Column, slope: float) -> Column:
    """The floor exists and is wide enough to work on."""
    return (bottom(length, depth, slope) >= MIN_BOTTOM_M) & (bottom(width, depth, slope) >= MIN_BOTTOM_M)


def _prism(depth: Column, a1: Column, a2: Column) -> Column:
    return depth / 3.0 * (a1 + a2 + F.sqrt(a1 * a2))


def bottom_area(length: Column, width: Column, depth: Column, slope: float) -> Column:
    """Floor area, never negative."""
    zero = F.lit(0.0)
    return F.greatest(bottom(length, depth, slope), zero) * F.greatest(bottom(width, depth, slope), zero)


def storage(length: Column, width: Column, depth: Column, slope: float) -> Column:
    """Prismoidal volume of the water body."""
    return _prism(depth, length * width, bottom_area(length, width, depth, slope))


def excavation(length: Column, width: Column, depth: Column, slope: float, freeboard: float) -> Column:
    """Cut volume: storage plus the freeboard band on the same slopes."""
    grow = 2 * slope * freeboard
    return _prism(
        depth + freeboard, (length + grow) * (width + grow), bottom_area(length, width, depth, slope)
    )


def embankment(
    length: Column, width: Column, height: float = 1.0, top: float = 2.0, slope: float = 2.0
) -> Column:
    """Spoil bund around the rim."""
    return F.lit(height * (top + slope * height)) * 2 * (length + width)


def area_at(length: Column, width: Column, depth: Column, slope: float, level: Column) -> Column:
    """Water surface at ``level`` above the floor."""
    h = F.least(F.greatest(level, F.lit(0.0)), depth)
    return (bottom(length, depth, slope) + 2 * slope * h) * (bottom(width, depth, slope) + 2 * slope * h)


def volume_at(length: Column, width: Column, depth: Column, slope: float, level: Column) -> Column:
    """Stored volume at ``level`` above the floor."""
    h = F.least(F.greatest(level, F.lit(0.0)), depth)
    return _prism(h, area_at(length, width, depth, slope, h), bottom_area(length, width, depth, slope))


def solve_width(target: Column, depth: Column, aspect: Column, slope: float, steps: int = 12) -> Column:
    """Top width whose frustum (length = aspect × width) holds ``target``.

    Null when even the narrowest holds more.

    The volume grows and bends upward with the width, so Newton steps from a width that is
    certainly too large close in on the root from above; a dozen reach machine precision.
    """
    inset = 2 * slope * depth
    lo = inset + MIN_BOTTOM_M
    third = depth / 3.0

    def closer(w: Column, _: Column) -> Column:
        a1, a2 = aspect * w * w, (aspect * w - inset) * (w - inset)
        d1, d2 = 2 * aspect * w, 2 * aspect * w - inset * (1 + aspect)

        def step(q: Column) -> Column:
            root = F.sqrt(q["a1"] * q["a2"])
            gap = third * (q["a1"] + q["a2"] + root) - target
            rise = third * (d1 + d2 + (d1 * q["a2"] + q["a1"] * d2) / (2 * root))
            return F.greatest(w - gap / rise, lo)

        return let(F.struct(a1.alias("a1"), a2.alias("a2")), step)

    start = F.greatest(F.sqrt(target / (third * aspect)), lo)
    got = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, closer)

    def checked(w: Column) -> Column:
        exact = F.abs(storage(aspect * w, w, depth, slope) - target) <= F.lit(1e-6) * F.greatest(F.abs(target), F.lit(1.0))
        return F.when(exact, w).otherwise(F.raise_error(F.lit("the width did not converge")).cast("double"))

    return F.when(storage(aspect * lo, lo, depth, slope) <= target, let(got, checked))


def spillway(
    rain_25y: Column, flow_path: Column, slope_ratio: Column, area: Column, coefficient: Column, head: float = 0.3
) -> Column:
    """``struct<tc_min,intensity,peak,weir>``: time of concentration, design rain, peak, weir length."""
    slope = F.greatest(slope_ratio, F.lit(0.001))
    length = F.greatest(flow_path, F.lit(30.0))
    tc = F.lit(0.0195) * F.pow(length, F.lit(0.77)) * F.pow(slope, F.lit(-0.385))
    hours = F.greatest(tc / 60.0, F.lit(0.1))
    intensity = rain_25y * F.pow(hours / 24.0, F.lit(1.0 / 3.0)) / hours
    peak = coefficient * (intensity / 1000.0 / 3600.0) * area
    weir = F.greatest(peak / F.lit(1.7 * head**1.5), F.lit(1.0))
    return F.struct(
        tc.alias("tc_min"), intensity.alias("intensity"), peak.alias("peak"), weir.alias("weir")
    )


def target_storage(harvestable: Column) -> Column:
    """``struct<target,capped>``: harvestable volume clipped to the storage limits."""
    clipped = F.least(F.greatest(harvestable, F.lit(MIN_STORAGE_M3)), F.lit(MAX_STORAGE_M3))
    return F.struct(clipped.alias("target"), (harvestable > MAX_STORAGE_M3).alias("capped"))


def footprint(lon: Column, lat: Column, length: Column, width: Column) -> Column:
    """Closed ring of the pond rectangle around a point, in degrees."""
    m_per_deg = 111_320.0
    dx = length / 2 / (m_per_deg * F.cos(F.radians(lat)))
    dy = width / 2 / m_per_deg
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(
        *[F.struct((lon + sx * dx).alias("lon"), (lat + sy * dy).alias("lat")) for sx, sy in corners]
    )
