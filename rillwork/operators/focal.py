"""Neighbourhood windows on long cell tables.

``cells(<keys>, row, col, <value>)``. Cells are grouped in square tiles; a cell at a tile's rim
is also copied to the tiles it touches. One shuffle by tile then serves every window, and no
task ever holds more than one tile's row or column at a time however long the raster is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.session import attach

TILE = 256
#: Fixed order of the eight neighbours: name, row step, column step, direction code.
STEPS = (
    ("e", 0, 1, 1), ("se", 1, 1, 2), ("s", 1, 0, 4), ("sw", 1, -1, 8),
    ("w", 0, -1, 16), ("nw", -1, -1, 32), ("n", -1, 0, 64), ("ne", -1, 1, 128),
)


def to_tiles(cells: DataFrame, keys: Sequence[str], reach: int, tile: int = TILE) -> DataFrame:
    """Add ``_tr, _tc`` and copies for every tile within ``reach`` cells; ``_own`` marks home."""

    def span(c: str) -> Column:
        first = F.greatest(F.floor((F.col(c) - reach) / tile), F.lit(0))
        return F.sequence(first, F.floor((F.col(c) + reach) / tile))

    out = cells.withColumn("_tr", F.explode(span("row"))).withColumn("_tc", F.explode(span("col")))
    own = (F.col("_tr") == F.floor(F.col("row") / tile)) & (F.col("_tc") == F.floor(F.col("col") / tile))
    return out.withColumn("_own", own).repartition(*keys, "_tr", "_tc")


def neighbours(cells: DataFrame, keys: Sequence[str], value: str = "z", tile: int = TILE) -> DataFrame:
    """Add the eight neighbours' values as ``nw n ne w e sw s se``; null off the grid."""
    keys = list(keys)
    t = to_tiles(cells, keys, 1, tile)
    wr = W.partitionBy(*keys, "_tr", "_tc", "row").orderBy("col")
    wc = W.partitionBy(*keys, "_tr", "_tc", "col").orderBy("row")

    def beside(fn, axis: str, step: int, what: str, w) -> Column:
        return F.when(fn(axis).over(w) == F.col(axis) + step, fn(what).over(w))

    t = t.withColumn("w", beside(F.lag, "col", -1, value, wr)).withColumn("e", beside(F.lead, "col", 1, value, wr))
    t = t.withColumn("_line", F.struct("w", F.col(value).alias("c"), "e"))
    t = t.withColumn("_up", beside(F.lag, "row", -1, "_line", wc)).withColumn(
        "_dn", beside(F.lead, "row", 1, "_line", wc)
    )
    return t.filter("_own").select(
        *cells.columns, "_tr", "_tc",
        F.col("_up.w").alias("nw"), F.col("_up.c").alias("n"), F.col("_up.e").alias("ne"), "w", "e",
        F.col("_dn.w").alias("sw"), F.col("_dn.c").alias("s"), F.col("_dn.e").alias("se"),
    )


def fill_nodata(cells: DataFrame, keys: Sequence[str], value: str = "z") -> DataFrame:
    """Replace missing values by the raster's mean."""
    keys = list(keys)
    means = cells.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return attach(cells, means, keys).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def blur(cells: DataFrame, keys: Sequence[str], value: str, sigma: float, tile: int = TILE) -> DataFrame:
    """Separable Gaussian smoothing of a dense grid; the edge value repeats outside it."""
    keys = list(keys)
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [x / sum(raw) for x in raw]

    def along(df: DataFrame, line: str, axis: str) -> DataFrame:
        t = to_tiles(df, keys, radius, tile)
        w = W.partitionBy(*keys, "_tr", "_tc", line).orderBy(axis)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        total = F.lit(0.0)
        for k, wt in zip(range(-radius, radius + 1), weights):
            v = F.col(value)
            if k < 0:
                v = F.coalesce(F.lag(value, -k).over(w), first)
            elif k > 0:
                v = F.coalesce(F.lead(value, k).over(w), last)
            total = total + F.lit(wt) * v
        return t.withColumn("_g", total).filter("_own").select(
            *[F.col("_g").alias(value) if c == value else c for c in df.columns]
        )

    return along(along(cells, "col", "row"), "row", "col")


def _plus(nb: DataFrame, fn, value: str) -> Column:
    """Minimum or maximum over the cell and its four side neighbours; off-grid ones ignored."""
    return fn(F.col(value), F.col("n"), F.col("s"), F.col("w"), F.col("e"))


def morph(cells: DataFrame, keys: Sequence[str], value: str, steps: Sequence[str], tile: int = TILE) -> DataFrame:
    """Erosions (``-``) and dilations (``+``) with the plus-shaped 3×3 kernel, in order."""
    for s in steps:
        nb = neighbours(cells, keys, value, tile)
        hit = _plus(nb, F.least if s == "-" else F.greatest, value)
        cells = nb.withColumn("_m", hit).select(
            *[F.col("_m").alias(value) if c == value else c for c in cells.columns]
        )
    return cells


def open_close(cells: DataFrame, keys: Sequence[str], value: str, tile: int = TILE) -> DataFrame:
    """Opening, then closing."""
    return morph(cells, keys, value, "-++-", tile)


def isoline_segments(cells: DataFrame, keys: Sequence[str], interval: float, tile: int = TILE) -> DataFrame:
    """Marching-squares segments per level: one row per crossed 2×2 block and piece of line.

    Coordinates are grid units (row and column, fractional); a saddle gives two segments.
    """
    keys = list(keys)
    nb = neighbours(cells, keys, "z", tile).filter(
        F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("se").isNotNull() & F.col("z").isNotNull()
    )
    a, b, c, d = F.col("z"), F.col("e"), F.col("se"), F.col("s")
    lo, hi = F.least(a, b, c, d), F.greatest(a, b, c, d)
    first = F.ceil(lo / interval).cast("long")
    last = F.floor(hi / interval).cast("long")
    n = nb.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    n = n.withColumn("level", F.col("_k") * F.lit(float(interval)))
    lv = F.col("level")
    r, q = F.col("row").cast("double"), F.col("col").cast("double")

    def bit(v: Column, w: int) -> Column:
        return F.when(v >= lv, w).otherwise(0)

    case = bit(a, 8) + bit(b, 4) + bit(c, 2) + bit(d, 1)

    def at(v0: Column, v1: Column) -> Column:
        return (lv - v0) / (v1 - v0)

    top = F.struct(r.alias("r"), (q + at(a, b)).alias("c"))
    right = F.struct((r + at(b, c)).alias("r"), (q + 1).alias("c"))
    low = F.struct((r + 1).alias("r"), (q + at(d, c)).alias("c"))
    left = F.struct((r + at(a, d)).alias("r"), q.alias("c"))

    def seg(p: Column, s: Column) -> Column:
        return F.struct(p.alias("a"), s.alias("b"))

    one = {
        1: (left, low), 14: (left, low), 2: (low, right), 13: (low, right), 3: (left, right),
        12: (left, right), 4: (top, right), 11: (top, right), 6: (top, low), 9: (top, low),
        7: (left, top), 8: (left, top),
    }
    pieces = F.when(F.col("_case") == 5, F.array(seg(left, top), seg(low, right))).when(
        F.col("_case") == 10, F.array(seg(left, low), seg(top, right))
    )
    for k, (p, s) in one.items():
        pieces = pieces.when(F.col("_case") == k, F.array(seg(p, s)))
    n = n.withColumn("_case", case).filter(~F.col("_case").isin(0, 15))
    n = n.withColumn("_s", F.explode(pieces))
    return n.select(
        *keys, "level", "row", "col",
        F.col("_s.a.r").alias("r0"), F.col("_s.a.c").alias("c0"), F.col("_s.b.r").alias("r1"), F.col("_s.b.c").alias("c1"),
    )


def flow_direction(cells: DataFrame, keys: Sequence[str], cols: Column, value: str = "z", tile: int = TILE) -> DataFrame:
    """Steepest-descent receiver of every cell: ``cell, recv, dir``; the first steepest wins.

    ``cell`` is ``row * cols + col``; ``recv`` is null and ``dir`` 0 where nothing is lower.
    """
    nb = neighbours(cells, keys, value, tile)
    z = F.col(value)
    slopes = {
        name: F.coalesce((z - F.col(name)) / F.lit(math.sqrt(2.0) if dr and dc else 1.0), F.lit(0.0))
        for name, dr, dc, _ in STEPS
    }
    nb = nb.withColumns({f"_s_{k}": v for k, v in slopes.items()})
    best = F.greatest(*[F.col(f"_s_{k}") for k in slopes])
    nb = nb.withColumn("_best", best)
    cell = F.col("row").cast("long") * cols + F.col("col")
    code, recv = F.lit(None), F.lit(None)
    for i, (name, dr, dc, d8) in enumerate(STEPS):
        hit = F.col(f"_s_{name}") == F.col("_best")
        to = cell + F.lit(dr).cast("long") * cols + dc
        code = F.when(hit, d8) if i == 0 else code.when(hit, d8)
        recv = F.when(hit, to) if i == 0 else recv.when(hit, to)
    down = F.col("_best") > 0
    drop = [f"_s_{k}" for k in slopes]
    return nb.withColumns(
        {
            "cell": cell,
            "dir": F.when(down, code).otherwise(0),
            "recv": F.when(down, recv),
            # rim of the known terrain: some neighbour is off the grid or has no value
            "rim": F.greatest(*[F.col(k).isNull() for k, *_ in STEPS]),
        }
    ).drop("_best", *drop, *[k for k, *_ in STEPS])


def neighbour_pairs(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """One row per cell and neighbour position (``row2, col2``), for equi-joins on the grid."""
    steps = [(dr, dc) for _, dr, dc, _ in STEPS if diagonal or not (dr and dc)]
    offs = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in steps])
    out = cells.withColumn("_o", F.explode(offs))
    return out.withColumn("row2", F.col("row") + F.col("_o.dr")).withColumn(
        "col2", F.col("col") + F.col("_o.dc")
    ).drop("_o")
