"""Range joins, nearest neighbours and geometry on point, line and polygon tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.functions.bind import let
from rillwork.session import attach, cut
from rillwork.sources import rejects


def radius_join(
    points: DataFrame, places: DataFrame, xy: tuple[str, str], keys: Sequence[str], radius: float | str
) -> DataFrame:
    """Pairs of points and places whose ``xy`` distance is at most ``radius``.

    Both sides go to square buckets of the radius; a point visits its 3×3 buckets and meets the
    places there in an equi-join. ``radius`` is a number or a column of ``points``; with a column
    every point uses the bucket size of its own power of two, so small circles stay cheap.
    Place columns that clash get the suffix ``_place``.
    """
    keys = list(keys)
    x, y = xy
    clash = [c for c in places.columns if c in points.columns and c not in keys]
    p2 = places.withColumnsRenamed({c: f"{c}_place" for c in clash})
    px, py = (f"{x}_place" if x in clash else x), (f"{y}_place" if y in clash else y)
    if isinstance(radius, str):
        # one level per power of two in use: at most a few dozen, whatever the data
        level = F.ceil(F.log2(F.greatest(F.col(radius), F.lit(1e-12)))).cast("int")
        pts = points.withColumn("_lv", level)
        used = sorted(r[0] for r in pts.select("_lv").distinct().collect() if r[0] is not None)
        p2 = p2.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.expr("cast(array() as array<int>)")))
        size, limit = F.pow(F.lit(2.0), F.col("_lv")), F.col(radius)
        on = [*keys, "_lv", "_bx", "_by"]
    else:
        pts, size, limit = points, F.lit(float(radius)), F.lit(float(radius))
        on = [*keys, "_bx", "_by"]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = pts.withColumn("_o", F.explode(around))
    left = left.withColumn("_bx", F.floor(F.col(x) / size) + F.col("_o.a")).withColumn(
        "_by", F.floor(F.col(y) / size) + F.col("_o.b")
    ).drop("_o")
    right = p2.withColumn("_bx", F.floor(F.col(px) / size)).withColumn("_by", F.floor(F.col(py) / size))
    d = F.hypot(F.col(px) - F.col(x), F.col(py) - F.col(y))
    return left.join(right, on).filter(d <= limit).drop("_bx", "_by", "_lv")


def within(points: DataFrame, places: DataFrame, xy: tuple[str, str], keys: Sequence[str], radius: float, id: str) -> DataFrame:
    """Points with at least one place within ``radius``."""
    hit = radius_join(points, places, xy, keys, radius).select(*keys, id).distinct()
    return points.join(hit, [*keys, id], "left_semi")


def nearest_k(
    points: DataFrame, places: DataFrame, xy: tuple[str, str], keys: Sequence[str], id: str, k: int,
    start: float, tie: Sequence[str] = (), max_doublings: int = 40,
) -> DataFrame:
    """The ``k`` nearest places of every point, exact: the radius doubles for points still short.

    A point is settled once ``k`` places lie within its radius, or once the radius has covered
    every place of its key.
    """
    keys = list(keys)
    x, y = xy
    box = places.groupBy(*keys).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    far = F.hypot(
        F.greatest(F.abs(F.col(x) - F.col("_x0")), F.abs(F.col(x) - F.col("_x1"))),
        F.greatest(F.abs(F.col(y) - F.col("_y0")), F.abs(F.col(y) - F.col("_y1"))),
    )
    todo = cut(attach(points, box, keys).withColumn("_far", far).select(*points.columns, "_far"))
    out, radius = None, float(start)
    px = f"{x}_place" if x in points.columns else x
    py = f"{y}_place" if y in points.columns else y
    for _ in range(max_doublings):
        near = radius_join(todo, places, xy, keys, radius)
        near = near.withColumn("dist", F.hypot(F.col(px) - F.col(x), F.col(py) - F.col(y)))
        w = W.partitionBy(*keys, id).orderBy("dist", *tie)
        top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        top = cut(top)
        full = top.groupBy(*keys, id).agg(F.count(F.lit(1)).alias("_n"))
        state = todo.join(full, [*keys, id], "left").withColumn(
            "_ok", (F.coalesce("_n", F.lit(0)) >= k) | (F.col("_far") <= radius)
        )
        done = top.join(state.filter("_ok").select(*keys, id), [*keys, id], "left_semi").drop("_far")
        out = done if out is None else out.unionByName(done)
        todo = cut(state.filter("not _ok").drop("_n", "_ok"))
        if not todo.limit(1).count():
            return out
        radius *= 2
    raise RuntimeError("points are still short of neighbours; raise start or max_doublings")


def inverse_distance(near: DataFrame, keys: Sequence[str], id: str, value: str, power: float = 2.0) -> DataFrame:
    """Weighted mean of the neighbours' value; an exact hit wins outright."""
    hit = F.max(F.when(F.col("dist") == 0, F.col(value)))
    w = F.when(F.col("dist") > 0, F.pow(F.col("dist"), F.lit(-power)))
    return near.groupBy(*keys, id).agg(F.coalesce(hit, F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def fill_gaps(cells: DataFrame, keys: Sequence[str], value: str = "z", start: float = 4.0) -> DataFrame:
    """Give missing cells the value of the nearest valid one (first in scan order on ties)."""
    keys = list(keys)
    holes = cells.filter(F.col(value).isNull()).select(*keys, "row", "col", F.struct("row", "col").alias("_id"))
    valid = cells.filter(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).alias("_v"))
    near = nearest_k(holes, valid, ("row", "col"), keys, "_id", 1, start, ["row_place", "col_place"])
    return cells.join(near.select(*keys, "row", "col", "_v"), [*keys, "row", "col"], "left").withColumn(
        value, F.coalesce(value, "_v")
    ).drop("_v")


def resample_nearest(target: DataFrame, source: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """Value of the source cell under each target point (``sx, sy`` in source cells); else default."""
    t = target.withColumn("_r", F.floor("sy").cast("long")).withColumn("_c", F.floor("sx").cast("long"))
    s = source.select(*keys, F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), value)
    return t.join(s, [*keys, "_r", "_c"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(default))).drop("_r", "_c")


def resample_bilinear(target: DataFrame, source: DataFrame, keys: Sequence[str], id: str, value: str) -> DataFrame:
    """Bilinear value at each target point (``sx, sy`` in source cells, centres at .5).

    Missing corners drop out and the remaining weights are scaled up.
    """
    gx, gy = F.col("sx") - 0.5, F.col("sy") - 0.5
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    t = target.withColumn("_o", F.explode(corners))
    t = t.withColumn("_r", F.floor(gy) + F.col("_o.b")).withColumn("_c", F.floor(gx) + F.col("_o.a"))
    fx, fy = gx - F.floor(gx), gy - F.floor(gy)
    wx = F.when(F.col("_o.a") == 1, fx).otherwise(1 - fx)
    wy = F.when(F.col("_o.b") == 1, fy).otherwise(1 - fy)
    s = source.select(*keys, F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias("_v"))
    hit = t.withColumn("_w", wx * wy).join(s, [*keys, "_r", "_c"], "left").filter(F.col("_v").isNotNull() & (F.col("_w") > 0))
    return hit.groupBy(*keys, id).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))


def mosaic(tiles: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """First non-missing value per cell in tile order."""
    return tiles.filter(F.col(value).isNotNull()).groupBy(*keys, "row", "col").agg(F.min_by(value, rank).alias(value))


def tile_keys(boxes: DataFrame, step: int, id: str) -> DataFrame:
    """Lower-left corners of the ``step``-degree tiles each box touches, with the tile's name."""

    def span(lo: str, hi: str) -> Column:
        a = (F.floor(F.col(lo) / step) * step).cast("int")
        b = (F.floor(F.col(hi) / step) * step).cast("int")
        return F.sequence(a, b, F.lit(step))

    t = boxes.withColumn("lat", F.explode(span("south", "north"))).withColumn("lon", F.explode(span("west", "east")))
    ns = F.when(F.col("lat") < 0, "S").otherwise("N")
    ew = F.when(F.col("lon") < 0, "W").otherwise("E")
    name = F.concat(ns, F.lpad(F.abs("lat").cast("string"), 2, "0"), ew, F.lpad(F.abs("lon").cast("string"), 3, "0"))
    return t.select(id, "lat", "lon", name.alias("tile"))


def polygon_cells(cells: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """Cells a polygon covers or touches.

    ``edges(id, x0, y0, x1, y1)`` in grid units (column, row). Edges meet only the cell rows they
    span: the centre test counts crossings to the right per (polygon, row), and touched cells come
    from walking each edge row by row.
    """
    lo_y, hi_y = F.least("y0", "y1"), F.greatest("y0", "y1")
    flat = F.col("y0") == F.col("y1")
    # crossings of the horizontal line through a row's centre, half-open so a vertex counts once
    first = F.ceil(lo_y - 0.5).cast("long")
    last = (F.ceil(hi_y - 0.5) - 1).cast("long")
    cy = F.col("_row") + 0.5
    cross = (
        edges.filter(~flat & (first <= last))
        .withColumn("_row", F.explode(F.sequence(first, last)))
        .withColumn("x", F.col("x0") + (cy - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
        .select(id, F.col("_row").alias("row"), "x")
    )
    # pair crossings of a line in order: inside runs between odd and even ones. A line's crossings
    # are bounded by the polygon's edges over that row.
    w = W.partitionBy(id, "row").orderBy("x")
    runs = (
        cross.withColumn("_i", F.row_number().over(w)).withColumn("_x1", F.lead("x").over(w)).filter("_i % 2 = 1")
    )
    a, b = F.ceil(F.col("x") - 0.5).cast("long"), (F.ceil(F.col("_x1") - 0.5) - 1).cast("long")
    filled = runs.filter(a <= b).select(id, "row", F.explode(F.sequence(a, b)).alias("col"))
    # cells an edge passes through, one slab per row
    rows = F.sequence(F.floor(lo_y).cast("long"), F.floor(hi_y).cast("long"))
    e = edges.withColumn("row", F.explode(rows))
    top, low = F.greatest(lo_y, F.col("row").cast("double")), F.least(hi_y, F.col("row") + F.lit(1.0))

    def x_at(yv: Column) -> Column:
        return F.col("x0") + (yv - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))

    xa = F.when(flat, F.col("x0")).otherwise(x_at(top))
    xb = F.when(flat, F.col("x1")).otherwise(x_at(low))
    touch = e.withColumn(
        "col", F.explode(F.sequence(F.floor(F.least(xa, xb)).cast("long"), F.floor(F.greatest(xa, xb)).cast("long")))
    ).select(id, "row", "col")
    # bounded by the polygons' area, not the raster; the equi-join keeps the cells that exist
    hit = filled.unionByName(touch).distinct()
    hit = hit.select(id, F.col("row").alias("_r"), F.col("col").alias("_c"))
    spot = (F.col("row").cast("long") == F.col("_r")) & (F.col("col").cast("long") == F.col("_c"))
    return cells.join(hit, spot).drop("_r", "_c")


def mask_perimeter(mask: DataFrame, keys: Sequence[str], cell_size: float) -> DataFrame:
    """Length of the exposed cell edges of a mask."""
    keys = list(keys)
    offs = F.array(*[F.struct(F.lit(r).alias("a"), F.lit(c).alias("b")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    e = mask.select(*keys, "row", "col", F.explode(offs).alias("_o"))
    e = e.select(*keys, (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col"))
    open_edges = e.join(mask.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")
    g = open_edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))
    return g.withColumn("perimeter_m", F.col("edges") * F.lit(float(cell_size)))


def boundary_key(ring: Column, digits: int = 5) -> Column:
    """Hash that is equal for rings equal after rounding, whatever vertex they start at, either way round.

    ``ring`` is an array of ``struct<x,y>``; a repeated closing vertex is ignored. The order of the
    vertices counts: of all rotations in both directions the least one is hashed.
    """
    number = lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + 0.0)
    point = lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))

    def opened(pts: Column) -> Column:
        closed = (F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1))
        return F.when(closed, F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts)

    def rotations(p: Column) -> Column:
        def starting(low: Column) -> Column:
            turn = lambda i: F.concat_ws(";", F.slice(p, i, F.size(p)), F.slice(p, 1, i - 1))
            return F.transform(F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: F.element_at(p, i) == low), turn)

        return F.array_min(let(F.array_min(p), starting))

    # every step is named once: the texts of the points are long to make and used many times
    either = lambda p: F.least(rotations(p), let(F.reverse(p), rotations))
    return F.sha2(let(let(F.transform(ring, point), opened), either), 256)


def segments(lines: DataFrame, id: str, vertices: str) -> DataFrame:
    """Segments of polylines given as arrays of ``struct<x,y>``; no window needed."""
    pairs = F.expr(f"transform(sequence(0, greatest(size({vertices}) - 2, 0)), i -> struct({vertices}[i] as a, {vertices}[i+1] as b, i as i))")
    s = lines.filter(F.size(vertices) >= 2).select(id, F.explode(pairs).alias("s"))
    return s.select(
        id, F.col("s.i").alias("i"),
        F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"),
    )


def polyline_length(vertices: Column) -> Column:
    """Length of one polyline column."""
    n = F.size(vertices)
    idx = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(
        idx,
        F.lit(0.0),
        lambda acc, i: acc + F.hypot(vertices[i]["x"] - vertices[i - 1]["x"], vertices[i]["y"] - vertices[i - 1]["y"]),
    )


def densify(lines: DataFrame, id: str, vertices: str, step: float) -> DataFrame:
    """Evenly spaced vertices no further apart than ``step``; short lines keep their own."""
    seg = segments(lines, id, vertices).withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    w = W.partitionBy(id).orderBy("i")
    seg = seg.withColumn("to", F.sum("len").over(w)).withColumn("from", F.col("to") - F.col("len"))
    total = lines.select(id, polyline_length(F.col(vertices)).alias("total"), F.size(vertices).alias("_n"))
    long = total.filter(F.col("total") > step).withColumn("n", F.ceil(F.col("total") / step) + 1)
    s = seg.join(long.select(id, "total", "n"), id).withColumn("_gap", F.col("total") / (F.col("n") - 1))
    # targets k * gap that fall on this segment; the last segment also takes the end point
    last = F.col("i") == F.max("i").over(W.partitionBy(id))
    k0 = F.ceil(F.col("from") / F.col("_gap") - 1e-9)
    k1 = F.when(last, F.col("n") - 1).otherwise(F.ceil(F.col("to") / F.col("_gap") - 1e-9) - 1)
    s = s.withColumn("_k0", k0.cast("long")).withColumn("_k1", k1.cast("long")).filter("_k0 <= _k1")
    s = s.withColumn("k", F.explode(F.sequence("_k0", "_k1")))
    f = F.when(F.col("len") > 0, (F.col("k") * F.col("_gap") - F.col("from")) / F.col("len")).otherwise(0.0)
    f = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    dense = s.select(
        id, "k", (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("y")
    )
    short = total.filter(F.col("total") <= step).select(id)
    same = lines.join(short, id, "left_semi").select(id, F.posexplode(vertices).alias("k", "v")).select(
        id, F.col("k").cast("long").alias("k"), "v.x", "v.y"
    )
    return dense.unionByName(same)


def dedupe_vertices(points: DataFrame, keys: Sequence[str], order: Sequence[str], digits: int = 3) -> DataFrame:
    """First vertex per rounded position."""
    keys = list(keys)
    r = points.groupBy(*keys, F.round("x", digits).alias("_x"), F.round("y", digits).alias("_y")).agg(
        F.min_by(F.struct(*[c for c in points.columns if c not in keys]), F.struct(*order)).alias("_p")
    )
    return r.select(*keys, "_p.*")


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of a small point set, counter-clockwise."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull_area(points: DataFrame, keys: Sequence[str], pieces: int = 64) -> DataFrame:
    """Area of the convex hull of each key's points, in three narrowing steps.

    Every Arrow batch first shrinks to its own hulls where it lies, then ``pieces`` hashed parts
    per key shrink again, and only their few vertices meet in the final hull.
    """
    keys = list(keys)
    pts = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    types = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    schema = f"{head}, x double, y double"

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(h) for k in keys}, "x": h[:, 0], "y": h[:, 1]})

    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, part in pdf.groupby(keys, sort=False):
                yield shrink(part)

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        a = 0.0
        if len(h) > 2:
            x, y = h[:, 0], h[:, 1]
            a = 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "hull_area": [float(a)]})

    few = pts.mapInPandas(batches, schema).withColumn("_part", F.pmod(F.hash("x", "y"), F.lit(pieces)))
    few = few.groupBy(*keys, "_part").applyInPandas(shrink, schema)
    return few.groupBy(*keys).applyInPandas(area, f"{head}, hull_area double")


def contour_spacing(contours: DataFrame, pieces: int = 64) -> DataFrame:
    """Per map: total contour length, hull of the vertices, and spacing = hull area / length."""
    total = contours.groupBy("map_id").agg(F.sum(polyline_length(F.col("vertices"))).alias("length"))
    points = contours.select("map_id", F.explode("vertices").alias("v")).select("map_id", "v.x", "v.y")
    out = total.join(hull_area(points, ["map_id"], pieces), "map_id")
    return out.withColumn("spacing", F.try_divide("hull_area", "length"))


def contour_facts(contours: DataFrame) -> DataFrame:
    """Per map: lines, vertices, levels, interval (median gap between levels), elevation range, bounds."""
    bounds = {f"{c}_{n}": (fn, end, c) for c in "xy" for n, fn, end in (("min", F.min, F.array_min), ("max", F.max, F.array_max))}
    base = contours.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.size("vertices")).alias("vertices"),
        F.min("elevation").alias("z_min"),
        F.max("elevation").alias("z_max"),
        *[fn(end(F.col(f"vertices.{c}"))).alias(name) for name, (fn, end, c) in bounds.items()],
    )
    levels = contours.select("map_id", "elevation").distinct()  # one row per level, not per line
    w = W.partitionBy("map_id").orderBy("elevation")
    gaps = levels.withColumn("gap", F.col("elevation") - F.lag("elevation").over(w))
    per = gaps.groupBy("map_id").agg(F.count(F.lit(1)).alias("levels"), F.median("gap").alias("interval"))
    return base.join(per, "map_id")


def source_counts(contours: DataFrame) -> DataFrame:
    """How many lines got their elevation from each source."""
    return contours.groupBy("map_id", "source").agg(F.count(F.lit(1)).alias("lines"))


def checked_area(boxes: DataFrame, lo_km2: float, hi_km2: float) -> DataFrame:
    """Boxes with the ``reason`` why they are refused: ``too_small``, ``too_large`` or ``no_area``."""
    area = F.col("area_km2")
    return rejects.tag(boxes, {"no_area": area.isNull() | F.isnan(area), "too_small": area < lo_km2, "too_large": area > hi_km2})


def within_area(boxes: DataFrame, lo_km2: float, hi_km2: float) -> DataFrame:
    """Boxes whose area lies inside the limits."""
    return checked_area(boxes, lo_km2, hi_km2).filter("reason is null").drop("reason")


def score_text(texts: DataFrame, id: str, text: str, datasets: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Best data source per text: mentions plus five per mention inside a raster file name.

    ``datasets`` are ``(name, pattern, resolution)``; finer resolution wins ties, and a text that
    mentions none gets ``assumed``. One projection over the whole texts, no join.
    """
    t = F.lower(F.col(text))

    def in_files(p: str) -> Column:
        # the file pattern backtracks, so it only runs on texts that name a raster file at all
        hits = F.regexp_count(t, F.lit(rf"[\w/.-]*({p})[\w/.-]*\.tiff?\b"))
        return F.when(t.contains(".tif"), hits).otherwise(0)

    scored = F.array(
        *[
            F.struct(
                (
                    F.regexp_count(t, F.lit(p)) + 5 * in_files(p)
                ).cast("long").alias("score"),
                F.lit(-float(res)).alias("fine"),
                F.lit(ds).alias("dataset"),
            )
            for ds, p, res in datasets
        ]
    )
    best = texts.select(id, F.array_max(scored).alias("_b"))
    known = F.col("_b.score") > 0
    return best.select(
        id,
        F.when(known, F.col("_b.dataset")).otherwise("assumed").alias("dataset"),
        F.when(known, -F.col("_b.fine")).alias("resolution"),
        F.col("_b.score").alias("score"),
    )
