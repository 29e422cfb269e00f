"""Pond design per site: cheapest feasible geometry and derived figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import pond as P
from rillwork.functions.bind import let

#: Fixed values searched by the optimiser.
DEPTHS = tuple(1.5 + 0.25 * i for i in range(9))
ASPECTS = (1.0, 1.5, 2.0)


def candidates(
    sites: DataFrame, target: str, slope: float = 2.0, freeboard: float = 0.5, max_depth: float | None = None
) -> DataFrame:
    """Every feasible design of every site: one row per depth and aspect that stores the target."""
    depths = [d for d in DEPTHS if max_depth is None or d <= max_depth]
    grid = F.array(
        *[F.struct(F.lit(d).alias("depth"), F.lit(a).alias("aspect")) for d in depths for a in ASPECTS]
    )
    c = sites.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    # exploded, so that the columns below read the solved width and do not solve it again
    width = F.array(P.solve_width(F.col(target), F.col("depth"), F.col("aspect"), slope))
    c = c.withColumn("width", F.explode(width))
    c = c.filter(F.col("width").isNotNull()).withColumn("length", F.col("aspect") * F.col("width"))
    length, width, depth = F.col("length"), F.col("width"), F.col("depth")
    c = c.filter(P.feasible(length, width, depth, slope)).withColumns(
        {
            "excavation_m3": P.excavation(length, width, depth, slope, freeboard),
            "embankment_m3": P.embankment(length, width),
            "top_area_m2": length * width,
            "storage_m3": P.storage(length, width, depth, slope),
        }
    )
    return c.withColumn(
        "cost", P.EXCAVATION_RATE * F.col("excavation_m3") + P.EMBANKMENT_RATE * F.col("embankment_m3")
    )


def cheapest_design(designs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest rounded cost, then the smaller water surface."""
    keys = list(keys)
    rest = [c for c in designs.columns if c not in keys]
    order = F.struct(F.rint("cost"), F.col("top_area_m2"), F.col("depth"), F.col("aspect"))
    return designs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_d")).select(*keys, "_d.*")


def level_table(designs: DataFrame, keys: Sequence[str], step: float = 0.25, slope: float = 2.0) -> DataFrame:
    """Water surface and volume of the chosen pond at each level above its floor."""
    n = F.floor(F.col("depth") / step).cast("int")
    lv = designs.withColumn("level_m", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(step))))
    args = (F.col("length"), F.col("width"), F.col("depth"), slope, F.col("level_m"))
    return lv.select(*keys, "level_m", P.area_at(*args).alias("area_m2"), P.volume_at(*args).alias("volume_m3"))


def spillway_of(sites: DataFrame) -> Column:
    """Spillway struct from the columns ``rain_25y, longest_m, slope_ratio, area_m2, coefficient``."""
    return let(
        P.spillway(*[F.col(c) for c in ("rain_25y", "longest_m", "slope_ratio", "area_m2", "coefficient")]), lambda s: s
    )
