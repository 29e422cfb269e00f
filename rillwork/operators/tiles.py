"""Tile kernels: work on one bounded square of cells, glued together by small border joins.

A tile has at most ``tile × tile`` cells plus its halo, so a Python task never grows with the
raster. What crosses tile borders travels through joins on border cells only.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators.focal import STEPS, TILE, neighbour_pairs, neighbours, to_tiles
from rillwork.operators.ordered import split_row_number
from rillwork.session import cut_sized


def _frame(pdf: pd.DataFrame, extra: pd.DataFrame | None = None):
    """Row and column offset and the shape covering the given cells with a one-cell margin."""
    rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    if extra is not None and len(extra):
        rows = np.concatenate([rows, extra["row"].to_numpy()])
        cols = np.concatenate([cols, extra["col"].to_numpy()])
    r0, c0 = rows.min() - 1, cols.min() - 1
    return r0, c0, (int(rows.max() - r0 + 2), int(cols.max() - c0 + 2))


def _flood(z: np.ndarray, seeds: np.ndarray, level: np.ndarray, eps: float) -> np.ndarray:
    """Lowest spill surface over ``z`` given already known ``level`` at ``seeds``.

    Works on flat lists: the array carries a margin, so neighbours are plain index offsets.
    """
    width = z.shape[1]
    heights = z.ravel().tolist()
    out = np.where(seeds, level, np.inf).ravel().tolist()
    closed = (seeds | np.isnan(z)).ravel().tolist()
    steps = [dr * width + dc for _, dr, dc, _ in STEPS]
    heap = [(out[i], i) for i in np.flatnonzero(seeds).tolist()]
    heapq.heapify(heap)
    last = len(heights)
    while heap:
        m, i = heapq.heappop(heap)
        for d in steps:
            j = i + d
            if 0 <= j < last and not closed[j]:
                closed[j] = True
                out[j] = heights[j] if heights[j] > m else m + eps
                heapq.heappush(heap, (out[j], j))
    return np.array(out).reshape(z.shape)


def fill_depressions(
    cells: DataFrame, keys: Sequence[str], eps: float = 1e-4, tile: int = TILE, max_rounds: int = 10_000
) -> DataFrame:
    """Fill every depression to its spill height plus ``eps`` per step.

    A cell keeps its height where that is above its lowest filled neighbour ``m``, else takes
    ``m + eps``; cells at the edge of the known terrain stay. Each round solves all tiles whose
    halo changed and hands only their border cells on; rounds grow with the tiles a spill path
    crosses, not with its cells. Adds ``filled`` and ``depth``.
    """
    keys = list(keys)
    nb = neighbours(cells, keys, "z", tile).filter(F.col("z").isNotNull())
    edge = F.lit(False)
    for name, *_ in STEPS:
        edge = edge | F.col(name).isNull()
    grid = cut_sized(nb.withColumn("_fix", edge).select(*cells.columns, "_tr", "_tc", "_fix"))
    tile_keys = [*keys, "_tr", "_tc"]
    key_types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    head = ", ".join(f"{k} {key_types[k]}" for k in tile_keys)
    schema = f"{head}, row {key_types['row']}, col {key_types['col']}, filled double"

    def solve(only_border: bool):
        def run(own: pd.DataFrame, halo: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return own.assign(filled=0.0)[[*tile_keys, "row", "col", "filled"]]
            r0, c0, shape = _frame(own, halo)
            z, lev = np.full(shape, np.nan), np.full(shape, np.inf)
            seeds = np.zeros(shape, dtype=bool)
            r, c = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
            z[r, c] = own["z"].to_numpy()
            fixed = own["_fix"].to_numpy()
            seeds[r[fixed], c[fixed]] = True
            lev[r[fixed], c[fixed]] = z[r[fixed], c[fixed]]
            if len(halo):
                hr, hc = halo["row"].to_numpy() - r0, halo["col"].to_numpy() - c0
                seeds[hr, hc] = True
                lev[hr, hc] = halo["filled"].to_numpy()
            done = _flood(z, seeds, lev, eps)
            out = own[[*tile_keys, "row", "col"]].assign(filled=done[r, c])
            if only_border:
                rr, cc = own["row"].to_numpy() % tile, own["col"].to_numpy() % tile
                out = out[((rr == 0) | (rr == tile - 1) | (cc == 0) | (cc == tile - 1)) & np.isfinite(done[r, c])]
            return out

        return run

    def onward(border: DataFrame) -> DataFrame:
        """Border cells addressed to the neighbouring tiles that see them."""
        plain = border.drop("_tr", "_tc")
        return to_tiles(plain, keys, 1, tile).filter("not _own").drop("_own")

    halo = cut_sized(grid.select(*tile_keys, "row", "col", F.lit(0.0).alias("filled")).filter("false"))
    active = None
    spot = [*tile_keys, "row", "col"]
    for _ in range(max_rounds):
        todo = grid if active is None else grid.join(active, tile_keys, "left_semi")
        seen = halo if active is None else halo.join(active, tile_keys, "left_semi")
        border = todo.groupBy(*tile_keys).cogroup(seen.groupBy(*tile_keys)).applyInPandas(solve(True), schema)
        sent = onward(border).select(*spot, F.col("filled").alias("_new"))
        merged = halo.join(sent, spot, "full_outer").select(
            *spot,
            F.coalesce("_new", "filled").alias("filled"),
            (F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("filled"))).alias("_moved"),
        )
        merged = cut_sized(merged)
        active = merged.filter("_moved").select(*tile_keys).distinct()
        halo = merged.drop("_moved")
        if not active.limit(1).count():
            break
    else:
        raise RuntimeError("filling did not settle; raise max_rounds")
    full = grid.groupBy(*tile_keys).cogroup(halo.groupBy(*tile_keys)).applyInPandas(solve(False), schema)
    return (
        grid.drop("_fix")
        .join(full, spot)
        .drop("_tr", "_tc")
        .withColumn("depth", F.col("filled") - F.col("z"))
    )


def _local_labels(mask: np.ndarray, ids: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest id of every connected group in a small mask, by repeated neighbour minima."""
    big = np.iinfo(np.int64).max
    lab = np.where(mask, ids, big)
    steps = [(dr, dc) for _, dr, dc, _ in STEPS if diagonal or not (dr and dc)]
    while True:
        new = lab.copy()
        for dr, dc in steps:
            new = np.minimum(new, np.roll(lab, (dr, dc), (0, 1)))
        # slide along rows and columns at once: whole runs settle in one sweep
        new = np.where(mask, new, big)
        for axis in (0, 1):
            for flip in (False, True):
                a = np.flip(new, axis) if flip else new
                gap = np.flip(mask, axis) if flip else mask
                seg = np.cumsum(~gap, axis=axis)
                a = _segment_min(a, seg, axis)
                new = np.flip(a, axis) if flip else a
        new = np.where(mask, new, big)
        if np.array_equal(new, lab):
            return lab
        lab = new


def _segment_min(a: np.ndarray, seg: np.ndarray, axis: int) -> np.ndarray:
    """Running minimum along ``axis`` that restarts whenever ``seg`` changes."""
    moved, s = np.moveaxis(a, axis, 1).copy(), np.moveaxis(seg, axis, 1)
    for j in range(1, moved.shape[1]):
        keep = s[:, j] == s[:, j - 1]
        moved[:, j] = np.where(keep, np.minimum(moved[:, j], moved[:, j - 1]), moved[:, j])
    return np.moveaxis(moved, 1, axis)


def label_components(mask: DataFrame, keys: Sequence[str], diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """Label the cells of a mask by connected group; ``cell`` must grow in scan order.

    Tiles are labelled on their own; the label graph across tile borders is then joined up.
    ``label`` is the smallest cell of the group.
    """
    keys = list(keys)
    t = to_tiles(mask, keys, 0, tile).drop("_own")
    types = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    out_cols = [*keys, "row", "col", "cell"]
    schema = ", ".join(f"{c} {types[c]}" for c in out_cols) + ", _local long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, shape = _frame(pdf)
        m, ids = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=np.int64)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        m[r, c] = True
        ids[r, c] = pdf["cell"].to_numpy()
        return pdf[out_cols].assign(_local=_local_labels(m, ids, diagonal)[r, c])

    local = cut_sized(t.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema))
    rim_r, rim_c = F.col("row") % tile, F.col("col") % tile
    rim = local.filter(rim_r.isin(0, tile - 1) | rim_c.isin(0, tile - 1))
    pairs = neighbour_pairs(rim.select(*keys, "row", "col", F.col("_local").alias("a")), diagonal)
    other = rim.select(*keys, F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("_local").alias("b"))
    edges = pairs.join(other, [*keys, "row2", "col2"]).filter("a <> b").select(*keys, "a", "b").distinct()
    roots = connect(edges, keys)
    lookup = roots.select(*keys, F.col("node").alias("_local"), F.col("root"))
    return local.join(lookup, [*keys, "_local"], "left").select(
        *out_cols, F.coalesce("root", "_local").alias("label")
    )


def connect(edges: DataFrame, keys: Sequence[str], max_rounds: int = 200) -> DataFrame:
    """Smallest node reachable from each node of a symmetric edge table: ``node, root``.

    Each round takes the smallest neighbouring label, lets the group's root follow it, and then
    jumps to the label of the label, so long chains collapse in logarithmically many rounds.
    """
    keys = list(keys)
    e = cut_sized(edges.select(*keys, "a", "b"))
    lab = e.select(*keys, F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    lab = cut_sized(lab)
    for _ in range(max_rounds):
        near = (
            e.join(lab.select(*keys, F.col("node").alias("b"), "root"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("root").alias("_near"))
        )
        low = lab.join(near, [*keys, "node"]).select(
            *keys, "node", "root", F.least("root", "_near").alias("_low")
        )
        # a whole group follows the best label any of its members has seen
        hook = low.groupBy(*keys, F.col("root").alias("node")).agg(F.min("_low").alias("_hook"))
        low = low.join(hook, [*keys, "node"], "left").select(
            *keys, "node", "root", F.least("_low", "_hook").alias("_low")
        )
        hop = low.select(*keys, F.col("node").alias("_low"), F.col("_low").alias("_jump"))
        nxt = low.join(hop, [*keys, "_low"], "left").select(
            *keys, "node", F.coalesce("_jump", "_low").alias("_r"), "root"
        )
        nxt = cut_sized(nxt.select(*keys, "node", F.col("_r").alias("root"), (F.col("_r") < F.col("root")).alias("_moved")))
        lab = nxt.drop("_moved")
        if not nxt.filter("_moved").limit(1).count():
            return lab
    raise RuntimeError("labels did not settle; raise max_rounds")


def number_components(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number groups from 1 in scan order of their first cell; adds ``number`` and ``size``."""
    keys = list(keys)
    sizes = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))
    return split_row_number(sizes, keys, F.floor(F.col("label") / (1 << 20)), ["label"], "number")


def keep_large(labelled: DataFrame, keys: Sequence[str], min_cells: float) -> DataFrame:
    """Cells of groups with at least ``min_cells`` cells."""
    keys = list(keys)
    big = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cells)
    return labelled.join(big.drop("_n"), [*keys, "label"], "left_semi")


def mask_distance(cells: DataFrame, keys: Sequence[str], mask: str, reach: int, tile: int = TILE) -> DataFrame:
    """Squared distance in cells to the nearest mask cell, exact up to ``reach``; null beyond.

    Only mask cells are copied into the tiles they can reach; no cell pairs are built.
    """
    keys = list(keys)
    near = to_tiles(cells.filter(F.col(mask)).select(*keys, "row", "col"), keys, reach, tile)
    # fresh names: both sides of the cogroup come from the same cells
    near = near.select(*[F.col(k).alias(f"{k}_hit") for k in (*keys, "_tr", "_tc", "row", "col")])
    own = to_tiles(cells, keys, 0, tile).drop("_own")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields]
    schema = ", ".join(fields) + ", d2 long"
    names = own.columns
    far = (reach + 1) ** 2 * 4

    def run(mine: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({**{c: mine[c] for c in names}, "d2": pd.Series(dtype="Int64")})
        if not len(hits):
            return mine.assign(d2=pd.array([None] * len(mine), dtype="Int64"))
        r0, c0 = mine["row"].min() - reach, mine["col"].min() - reach
        shape = (int(mine["row"].max() - r0 + reach + 1), int(mine["col"].max() - c0 + reach + 1))
        inside = np.zeros(shape, dtype=bool)
        hr, hc = hits["row_hit"].to_numpy() - r0, hits["col_hit"].to_numpy() - c0
        ok = (hr >= 0) & (hc >= 0) & (hr < shape[0]) & (hc < shape[1])
        inside[hr[ok], hc[ok]] = True
        # nearest mask row in each column, from above and from below
        idx = np.arange(shape[0])[:, None]
        up = np.maximum.accumulate(np.where(inside, idx, -far), axis=0)
        dn = np.minimum.accumulate(np.where(inside, idx, 2 * far + shape[0])[::-1], axis=0)[::-1]
        g = np.minimum(np.minimum(idx - up, dn - idx), reach + 1).astype(np.int64) ** 2
        r, c = mine["row"].to_numpy() - r0, mine["col"].to_numpy() - c0
        best = np.full(len(mine), np.iinfo(np.int64).max)
        for dc in range(-reach, reach + 1):
            best = np.minimum(best, g[r, c + dc] + dc * dc)
        d2 = pd.array(best, dtype="Int64")
        d2[best > reach * reach] = pd.NA
        return mine.assign(d2=d2)

    tile_keys = [*keys, "_tr", "_tc"]
    hit_keys = [f"{k}_hit" for k in tile_keys]
    pairs = own.groupBy(*tile_keys).cogroup(near.groupBy(*hit_keys))
    return pairs.applyInPandas(run, schema).drop("_tr", "_tc")
