"""Water behind a bund: area and volume at several levels, for many sites at once.

A pool of a site holds the cells that the water reaches from the site without rising above the level and
without going below the site (cells upstream on a filled surface never lie below it). Sites are dealt by
tile with the cells around them, and a task floods each of its sites once, lowest cell first, which gives
all levels together. Only sites whose water meets the rim of their window are dealt again, with a window
of twice the size. Water that leaves the largest window is followed ring by ring over the whole raster, so
that no task ever holds more than ``LARGEST`` x ``LARGEST`` cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators.focal import neighbour_pairs
from rillwork.session import attach, cut_sized

#: Side of the first tiles (their halo is half of it) and of the largest window.
TILE, LARGEST = 64, 2048


def _flood(z: np.ndarray, r: int, c: int, rise: float) -> tuple[list[float], list[float], bool]:
    """Least water level that reaches each cell of the pool, its height, and whether the window's rim is wet."""
    rows, cols = z.shape
    z0 = z[r, c]
    seen = {(r, c)}
    heap = [(z0, r, c)]
    reach, height, rim = [], [], False
    while heap:
        level, r, c = heapq.heappop(heap)
        reach.append(level)
        height.append(z[r, c])
        rim |= r in (0, rows - 1) or c in (0, cols - 1)
        for a in range(max(r - 1, 0), min(r + 2, rows)):
            for b in range(max(c - 1, 0), min(c + 2, cols)):
                h = z[a, b]
                if (a, b) not in seen and z0 <= h < z0 + rise:
                    seen.add((a, b))
                    heapq.heappush(heap, (max(level, h), a, b))
    return reach, height, rim


def _window(keys: list[str], levels: list[float], tile: int, key: tuple, sites: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Cells and depths of every site of a tile at each level, null where the water leaves the window."""
    names = [*keys, "site", "z0", "n", "depth"]
    if not len(sites) or not len(cells):
        return pd.DataFrame(columns=names)
    halo = tile // 2
    top, left = key[-2] * tile - halo, key[-1] * tile - halo
    z = np.full((tile + 2 * halo,) * 2, np.nan)
    z[cells["row"].to_numpy() - top, cells["col"].to_numpy() - left] = cells["z"].to_numpy()
    rise = np.array(levels)
    out = []
    for site, r, c in zip(sites["site"], sites["row"] - top, sites["col"] - left):
        z0 = z[r, c]
        if np.isnan(z0):
            continue
        reach, height, rim = _flood(z, r, c, rise.max())
        n = depth = None
        if not rim:
            wet = np.array(reach)[None, :] < (z0 + rise)[:, None]
            n = wet.sum(axis=1).tolist()
            depth = np.where(wet, (z0 + rise)[:, None] - np.array(height)[None, :], 0.0).sum(axis=1).tolist()
        out.append((*key[:-2], site, z0, n, depth))
    return pd.DataFrame(out, columns=names)


def _rings(sites: DataFrame, grid: DataFrame, keys: list[str], levels: list[float], max_rounds: int) -> DataFrame:
    """The same for pools of any size: all pools grow by one ring of cells a round."""
    spot = [*keys, "site", "row", "col"]
    rise = F.lit(float(max(levels)))
    first = sites.select(*spot).join(grid, [*keys, "row", "col"])
    best = cut_sized(first.select(*spot, "z", F.col("z").alias("reach"), F.col("z").alias("z0")))
    front = best
    for _ in range(max_rounds):
        near = neighbour_pairs(front.select(*spot, "reach", "z0")).drop("row", "col")
        near = near.withColumnsRenamed({"row2": "row", "col2": "col"})
        step = near.join(grid, [*keys, "row", "col"]).where((F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z0") + rise))
        found = step.groupBy(*spot).agg(F.min(F.greatest("reach", "z")).alias("_new"), F.first("z").alias("_z"), F.first("z0").alias("_z0"))
        both = best.join(found, spot, "full_outer")
        better = F.col("_new").isNotNull() & (F.col("reach").isNull() | (F.col("_new") < F.col("reach")))
        both = cut_sized(
            both.select(
                *spot, F.coalesce("z", "_z").alias("z"), F.when(better, F.col("_new")).otherwise(F.col("reach")).alias("reach"),
                F.coalesce("z0", "_z0").alias("z0"), better.alias("_moved"),
            )
        )
        best, front = both.drop("_moved"), both.where("_moved").drop("_moved")
        if front.isEmpty():
            break
    else:
        raise RuntimeError("pool did not settle; raise max_rounds")
    wet = [F.col("reach") < F.col("z0") + F.lit(x) for x in levels]
    return best.groupBy(*keys, "site").agg(
        F.first("z0").alias("z0"),
        F.array(*[F.count_if(w) for w in wet]).alias("n"),
        F.array(*[F.sum(F.when(w, F.col("z0") + F.lit(x) - F.col("z")).otherwise(0.0)) for w, x in zip(wet, levels)]).alias("depth"),
    )


def pool_levels(
    sites: DataFrame, surface: DataFrame, keys: Sequence[str], levels: Sequence[float], cell_area: float,
    tile: int = TILE, largest: int = LARGEST, max_rounds: int = 100_000,
) -> DataFrame:
    """``<keys>, site, z0, level_m, elevation_m, area_m2, volume_m3``: the pool of each site at every level above it.

    ``sites(<keys>, site, row, col)``, ``surface(<keys>, row, col, z)``. A cell is flooded at a level when its
    height is below it. Sites off the raster, or on a cell without height, are left out.
    """
    keys, levels = list(keys), [float(x) for x in levels]
    # columns of their own, as sites are often cells of the same surface
    fresh = [F.col(c).alias(c) for c in (*keys, "row", "col")]
    grid = surface.select(*fresh, F.col("z").cast("double").alias("z")).where("z is not null")
    todo = cut_sized(sites.select(*keys, "site", "row", "col"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*keys, "site").schema.fields)
    schema = f"{kinds}, z0 double, n array<long>, depth array<double>"
    parts = []
    while 2 * tile <= largest:
        place = {"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)}
        own = todo.withColumns(place)
        wanted = own.select(*keys, "_tr", "_tc").distinct()
        # every cell serves the tiles whose window holds it: two at most in each direction, as the halo is half a tile
        reach = [F.sequence(F.floor((F.col(c) - tile // 2) / tile), F.floor((F.col(c) + tile // 2) / tile)) for c in ("row", "col")]
        spread = grid.withColumn("_tr", F.explode(reach[0])).withColumn("_tc", F.explode(reach[1]))
        inside = (F.col("row") - F.col("_tr") * tile).between(-(tile // 2), tile + tile // 2 - 1) & (F.col("col") - F.col("_tc") * tile).between(-(tile // 2), tile + tile // 2 - 1)
        cells = attach(spread.where(inside), wanted, [*keys, "_tr", "_tc"])
        by = [*keys, "_tr", "_tc"]
        got = own.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(partial(_window, keys, levels, tile), schema)
        got = cut_sized(got)
        parts.append(got.where("n is not null"))
        todo = cut_sized(todo.join(got.where("n is null").select(*keys, "site"), [*keys, "site"], "left_semi"))
        if todo.isEmpty():
            break
        tile *= 2
    else:
        parts.append(cut_sized(_rings(todo, grid, keys, levels, max_rounds)))
    pools = parts[0]
    for part in parts[1:]:
        pools = pools.unionByName(part)
    at = F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("n"), F.col("depth"))
    rows = pools.select(*keys, "site", "z0", F.inline(at))
    return rows.select(
        *keys, "site", "z0", F.col("level").alias("level_m"), (F.col("z0") + F.col("level")).alias("elevation_m"),
        (F.col("n") * F.lit(float(cell_area))).alias("area_m2"), (F.col("depth") * F.lit(float(cell_area))).alias("volume_m3"),
    )
