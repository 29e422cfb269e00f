"""Column functions over a 3×3 neighbourhood: gradients, slope, aspect, shade, curvature, wetness."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def edge_filled(z: str = "z") -> dict[str, Column]:
    """The eight neighbours with off-grid ones replaced by the nearest grid cell."""
    c = {k: F.col(k) for k in SIDES}
    me = F.col(z)
    return {
        "nw": F.coalesce(c["nw"], c["w"], c["n"], me),
        "n": F.coalesce(c["n"], me),
        "ne": F.coalesce(c["ne"], c["e"], c["n"], me),
        "w": F.coalesce(c["w"], me),
        "e": F.coalesce(c["e"], me),
        "sw": F.coalesce(c["sw"], c["w"], c["s"], me),
        "s": F.coalesce(c["s"], me),
        "se": F.coalesce(c["se"], c["e"], c["s"], me),
    }


def gradients(nb: dict[str, Column], cell: Column) -> tuple[Column, Column]:
    """``(dz/dx, dz/dy)`` by the weighted 3×3 differences; y grows northward."""
    dx = ((nb["ne"] + 2 * nb["e"] + nb["se"]) - (nb["nw"] + 2 * nb["w"] + nb["sw"])) / (8.0 * cell)
    dy = ((nb["nw"] + 2 * nb["n"] + nb["ne"]) - (nb["sw"] + 2 * nb["s"] + nb["se"])) / (8.0 * cell)
    return dx, dy


def slope_deg(dx: Column, dy: Column) -> Column:
    """Slope in degrees."""
    return F.degrees(F.atan(F.hypot(dx, dy)))


def slope_pct(slope: Column) -> Column:
    """Slope in per cent from degrees."""
    return F.tan(F.radians(slope)) * 100.0


def aspect_deg(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north; null on flat ground."""
    a = F.degrees(F.atan2(dx, dy))
    return F.when(F.hypot(dx, dy) >= 1e-9, F.when(a < 0, a + 360.0).otherwise(a))


def hillshade(dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Illumination scaled to 1..255."""
    slope = F.atan(F.hypot(dx, dy))
    zen, az = math.radians(90.0 - altitude), math.radians(azimuth)
    shade = F.lit(math.cos(zen)) * F.cos(slope) + F.lit(math.sin(zen)) * F.sin(slope) * F.cos(
        F.lit(az) - F.atan2(dx, dy)
    )
    return F.rint(1.0 + 254.0 * F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)))


def curvatures(nb: dict[str, Column], z: Column, cell: Column) -> tuple[Column, Column]:
    """``(profile, plan)`` curvature times 100; 0 where the ground is flat."""
    d = ((nb["w"] + nb["e"]) / 2 - z) / (cell * cell)
    e = ((nb["n"] + nb["s"]) / 2 - z) / (cell * cell)
    f = (-nb["nw"] + nb["ne"] + nb["sw"] - nb["se"]) / (4 * cell * cell)
    g = (-nb["w"] + nb["e"]) / (2 * cell)
    h = (nb["n"] - nb["s"]) / (2 * cell)
    den = g * g + h * h
    profile = -2 * (d * g * g + e * h * h + f * g * h) / den
    plan = -2 * (d * h * h + e * g * g - f * g * h) / den
    flat = den < 1e-12
    return F.when(flat, 0.0).otherwise(profile * 100), F.when(flat, 0.0).otherwise(plan * 100)


def wetness(dx: Column, dy: Column, acc: Column, cell: Column) -> Column:
    """Topographic wetness index with a floor of 0.001 on the slope."""
    tan_b = F.greatest(F.hypot(dx, dy), F.lit(0.001))
    return F.ln(F.greatest(acc.cast("double") * cell, cell) / tan_b)


def log_accumulation(acc: Column) -> Column:
    """Accumulation on a log scale for display."""
    return F.log10(F.greatest(acc, F.lit(1)).cast("double"))


def ndwi(green: Column, nir: Column) -> Column:
    """Water index; null where both bands are zero."""
    return F.when(green + nir > 0, (green - nir) / (green + nir))


def byte_scale(index: Column) -> Column:
    """Index in [-1, 1] to 0..255, truncated."""
    return F.least(F.greatest((index + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int")


def through(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Straight lines through ``(x, y)`` knots of growing x; level beyond the first and the last."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        if x1 > x0:
            out = out.when(x <= x1, y0 + (y1 - y0) * ((x - x0) / (x1 - x0)))
    return out.when(x.isNotNull(), F.lit(float(knots[-1][1])))


def hill(bounds: Sequence[float]) -> list[tuple[float, float]]:
    """Knots of a score that is 0 up to the first bound, 1 between the two inner ones, 0 from the last."""
    return list(zip(bounds, (0.0, 1.0, 1.0, 0.0), strict=True))


def plateau(slope: Column, best_to: float = 3.0, limit: float = 15.0) -> Column:
    """1 up to ``best_to`` per cent, falling to 0 at ``limit``."""
    return F.greatest(F.least((F.lit(limit) - slope) / (limit - best_to), F.lit(1.0)), F.lit(0.0))


def weighted_score(weights: dict[str, float], parts: dict[str, Column], renormalise: bool = False) -> Column:
    """Weighted sum of the parts named in ``weights``."""
    total = sum(weights.get(k, 0.0) for k in parts) if renormalise else 1.0
    if total <= 0:
        return F.lit(0.0)
    out = F.lit(0.0)
    for k, w in weights.items():
        if k in parts:
            out = out + F.lit(w / total) * parts[k]
    return out
