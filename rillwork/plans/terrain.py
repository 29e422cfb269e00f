"""Composite terrain jobs: products, catchments of many pour points, ranked pond sites."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import terrain as T
from rillwork.operators import flow as FL
from rillwork.operators import focal as FO
from rillwork.operators import ordered as O
from rillwork.operators import pools as PL
from rillwork.operators import tiles as TI
from rillwork.plans import land as LP
from rillwork.session import cut_sized


def flow_model(
    surface: DataFrame, keys: Sequence[str], cols: Column, cell_size: float, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Cells with slope, curvature, wetness, receiver and the measures of the catchment above each."""
    keys = list(keys)
    nb = FO.neighbours(surface, keys)
    dx, dy = T.gradients(T.edge_filled(), F.lit(float(cell_size)))
    profile, plan = T.curvatures(T.edge_filled(), F.col("z"), F.lit(float(cell_size)))
    nb = nb.withColumns({"dx": dx, "dy": dy, "profile": profile, "plan": plan}).drop("_tr", "_tc", *T.SIDES)
    f = cut_sized(FO.flow_direction(nb, keys, cols).withColumn("slope", T.slope_deg(F.col("dx"), F.col("dy"))))
    acc = FL.accumulate(
        f, keys,
        sums={"acc": F.lit(1).cast("long"), "slope_sum": F.col("slope"), **(extra or {})},
        maxima={"fed": F.col("rim"), "z_max": F.col("z")},
        minima={"z_min": F.col("z")},
        step=FL.step_length(cols, cell_size),
    )
    m = f.join(acc, [*keys, "cell"])
    twi = T.wetness(F.col("dx"), F.col("dy"), F.col("acc"), F.lit(float(cell_size)))
    return m.withColumns({"twi": twi, "slope_pct": T.slope_pct(F.col("slope")), "log_acc": T.log_accumulation(F.col("acc"))})


def terrain_products(
    heights: DataFrame, keys: Sequence[str], cols: Column, cell_size: float
) -> tuple[DataFrame, DataFrame]:
    """Every surface per cell, and the display limits (2nd and 98th percentile) per surface."""
    keys = list(keys)
    fixed = TI.fill_depressions(heights, keys)
    surface = cut_sized(fixed.withColumn("z", F.col("filled")).drop("filled"))
    model = flow_model(surface, keys, cols, cell_size)
    dx, dy = F.col("dx"), F.col("dy")
    cells = cut_sized(model.withColumns({"aspect": T.aspect_deg(dx, dy), "shade": T.hillshade(dx, dy)}))
    layers = ("z", "slope", "shade", "twi", "log_acc")
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in layers]))
    p = O.percentiles_linear(cells.select(*keys, pairs), [*keys, "layer"], "v", {"lo": 0.02, "hi": 0.98})
    hi = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))
    return cells, p.withColumn("hi", hi)


def area_uncertainty(ring_pct: Column) -> Column:
    """Area band in per cent: the share of one ring of cells, kept between 15 and 50."""
    return F.when(ring_pct.isNotNull(), F.least(F.greatest(ring_pct, F.lit(15.0)), F.lit(50.0)))


def catchments(
    surface: DataFrame, keys: Sequence[str], points: DataFrame, cols: Column, cell_size: float,
    snap_m: float, min_area: float,
) -> DataFrame:
    """Snap every point to a channel and report its catchment, with outline and area band.

    A point with no channel within ``snap_m`` is ``widened`` to the best one of its raster. One on a raster
    without any keeps its row, with nulls and the ``reject`` reason.
    """
    return catchments_of(cut_sized(flow_model(surface, keys, cols, cell_size)), keys, points, cell_size, snap_m, min_area)


def catchments_of(model: DataFrame, keys: Sequence[str], points: DataFrame, cell_size: float, snap_m: float, min_area: float) -> DataFrame:
    """``catchments`` on a flow model that is there already."""
    keys = list(keys)
    snapped = FL.snap_anywhere(points, model, keys, snap_m, min_area, cell_size)
    m = model.select(*keys, "cell", F.col("acc").alias("cells"), "z_max", "z_min", "longest", "fed", "slope_sum")
    snapped = cut_sized(snapped.select(*keys, "point", "cell", "distance_m"))
    edges = FL.catchment_edges(model, keys, snapped.filter(F.col("cell").isNotNull()).select(*keys, "cell"))
    perimeter, area = F.col("edges") * F.lit(float(cell_size)), F.col("cells") * F.lit(cell_size**2)
    return snapped.join(m, [*keys, "cell"], "left").join(edges, [*keys, "cell"], "left").select(
        *keys, "point",
        F.col("cell").alias("outlet"),
        "distance_m",
        (F.col("distance_m") > snap_m + 1e-9).alias("widened"),
        "cells",
        area.alias("area_m2"),
        perimeter.alias("perimeter_m"),
        area_uncertainty(100.0 * perimeter * cell_size / F.greatest(area, F.lit(1.0))).alias("band_pct"),
        (F.col("z_max") - F.col("z_min")).alias("relief_m"),
        F.col("longest").alias("longest_m"),
        (F.col("slope_sum") / F.col("cells")).alias("mean_slope"),
        F.col("fed").alias("touches_edge"),
        F.when(F.col("cell").isNull(), "no_channel").alias("reject"),
    )


def rank_sites(
    heights: DataFrame, keys: Sequence[str], rows: Column, cols: Column, cell_size: float,
    stream_area: float, top_n: int = 5, rise: float = 2.0, belt_m: float = 200.0, apart_m: float = 200.0,
    margin: int = 3, area_ha=FL.AREA_HA,
) -> tuple[DataFrame, DataFrame]:
    """Ranked pond sites per raster and the counts of cells each rule removed.

    ``heights(<keys>, row, col, z)`` may have ``water`` (mapped water, no site) and ``inside`` (the area of interest).
    """
    surface, model = filled_model(heights, keys, cols, cell_size)
    return rank_sites_of(surface, model, keys, rows, cols, cell_size, stream_area, top_n, rise, belt_m, apart_m, margin, area_ha)


def filled_model(heights: DataFrame, keys: Sequence[str], cols: Column, cell_size: float) -> tuple[DataFrame, DataFrame]:
    """The filled surface and its flow model, with the columns ``water`` and ``inside`` where ``heights`` has them."""
    keys = list(keys)
    spot = [*keys, "row", "col"]
    marks = [c for c in ("water", "inside") if c in heights.columns]
    fixed = TI.fill_depressions(heights.select(*spot, "z"), keys)
    surface = cut_sized(fixed.withColumn("z", F.col("filled")).select(*spot, "z"))
    model = flow_model(surface, keys, cols, cell_size)
    if marks:
        model = model.join(heights.select(*spot, *[F.coalesce(c, F.lit(False)).alias(c) for c in marks]), spot)
    return surface, cut_sized(model)


def rank_sites_of(
    surface: DataFrame, model: DataFrame, keys: Sequence[str], rows: Column, cols: Column, cell_size: float,
    stream_area: float, top_n: int = 5, rise: float = 2.0, belt_m: float = 200.0, apart_m: float = 200.0,
    margin: int = 3, area_ha=FL.AREA_HA,
) -> tuple[DataFrame, DataFrame]:
    """``rank_sites`` on a filled surface and flow model that are there already."""
    keys = list(keys)
    area = cell_size**2
    need = max(10, round(stream_area / area))
    ha = F.col("acc") * area / 1e4
    model = model.withColumn("stream", F.col("acc") >= need)
    model = cut_sized(model.withColumn("major", F.col("stream") & (ha >= area_ha[2])))
    reach = math.ceil(belt_m / cell_size)
    near = TI.mask_distance(model.select(*keys, "row", "col", "major"), keys, "major", reach).drop("major")
    model = model.join(near, [*keys, "row", "col"]).withColumn("dist_major", F.sqrt("d2") * cell_size)
    flagged = cut_sized(
        FL.site_flags(model.filter("stream"), keys, rows, cols, area, margin=margin, belt_m=belt_m, area_ha=area_ha)
    )
    counts = FL.site_counts(flagged, keys, area)
    eligible = flagged.filter("eligible").withColumn("site", F.col("cell"))
    pools = PL.pool_levels(eligible.select(*keys, "site", "row", "col"), surface, keys, [rise], area)
    vol = pools.select(*keys, "site", "volume_m3", "area_m2")
    scored = cut_sized(FL.site_scores(eligible.join(vol, [*keys, "site"]), keys, area, area_ha=area_ha))
    best = FL.suppress_near(
        scored.select(*keys, F.col("cell").alias("id"), "row", "col", "score"), keys, apart_m / cell_size, top_n
    )
    detail = scored.select(
        *keys, F.col("cell").alias("id"), (F.col("acc") * F.lit(area)).alias("upstream_m2"), "slope_pct", "twi", "volume_m3", "area_m2", "efficiency",
        "s_upstream_area", "s_flatness", "s_wetness", "s_impoundment",
    )
    return best.join(detail, [*keys, "id"]), counts


def source_cross_check(
    first: DataFrame, second: DataFrame, keys: Sequence[str], rows: Column, cols: Column, cell_size: float, stream_area: float,
    major_area: float, snap_m: float, min_area: float, **ranking,
) -> tuple[DataFrame, DataFrame]:
    """How far two height sources of the same rasters agree: facts per raster, and one row per ranked site of either.

    Facts: bias, RMSE, RMSE without the bias and correlation in one pass over the joined cells; the share of each
    source's channels that the other has within one cell, and of the first's major channels (``major_area`` upstream)
    within two; the greatest upstream areas; the distance of the best sites. A site's row has its catchment in both
    sources, each snapped to its own channels, and the share of cells the two have in common; ``partner`` is the
    site of the other source whose catchment overlaps its own most, by the overlap table of all catchments.
    """
    keys = list(keys)
    area, need = cell_size**2, max(10, round(stream_area / cell_size**2))
    sides, tops = {}, {}
    for name, heights in (("a", first), ("b", second)):
        surface, model = filled_model(heights, keys, cols, cell_size)
        best, _ = rank_sites_of(surface, model, keys, rows, cols, cell_size, stream_area, **ranking)
        sides[name], tops[name] = model, cut_sized(best.select(*keys, "rank", "id", "row", "col"))
    channels = {n: m.filter(F.col("acc") >= need).select(*keys, "row", "col") for n, m in sides.items()}
    major = {n: m.filter(F.col("acc") * area >= major_area).select(*keys, "row", "col") for n, m in sides.items()}
    facts = LP.surface_agreement(first, second, keys)
    for name, x, y, reach in (("hit_a", channels["a"], channels["b"], 1), ("hit_b", channels["b"], channels["a"], 1), ("major_hit", major["a"], major["b"], 2)):
        facts = facts.join(LP.channel_agreement(x, y, keys, reach).withColumnRenamed("share", name), keys, "left")
    for n, m in sides.items():
        facts = facts.join(m.groupBy(*keys).agg((F.max("acc") * area / 1e4).alias(f"outlet_{n}_ha")), keys, "left")
    lead = [tops[n].filter("rank = 1").select(*keys, F.col("row").alias(f"_r{n}"), F.col("col").alias(f"_c{n}")) for n in ("a", "b")]
    apart = F.hypot(F.col("_ra") - F.col("_rb"), F.col("_ca") - F.col("_cb")) * cell_size
    facts = facts.join(lead[0].join(lead[1], keys).select(*keys, apart.alias("top_distance_m")), keys, "left")

    sites = cut_sized(tops["a"].withColumn("side", F.lit("a")).unionByName(tops["b"].withColumn("side", F.lit("b"))))
    points = sites.withColumn("point", F.struct("side", "rank"))
    cells = None  # catchment cells of every site in both sources: at most top_n sites of a raster and side
    found = sites
    for n, m in sides.items():
        own = FL.snap_anywhere(points.select(*keys, "point", "row", "col"), m, keys, snap_m, min_area, cell_size)
        own = cut_sized(own.select(*keys, "point.side", "point.rank", F.col("cell").alias("outlet"), (F.col("acc") * area / 1e4).alias(f"area_{n}_ha")))
        up = FL.upstream_cells(m, keys, own.filter("outlet is not null").select(*keys, F.col("outlet").alias("cell")))
        up = own.join(up, [*keys, "outlet"]).select(*keys, "side", "rank", F.lit(n).alias("source"), "cell")
        cells = up if cells is None else cells.unionByName(up)
        found = found.join(own.drop("outlet"), [*keys, "side", "rank"], "left")
    cells = cut_sized(cells)
    both = cells.groupBy(*keys, "side", "rank", "cell").agg(F.count(F.lit(1)).alias("n"))
    shared = both.groupBy(*keys, "side", "rank").agg((F.count(F.when(F.col("n") == 2, 1)) / F.count(F.lit(1))).alias("overlap"))
    # each site in its own source against the sites of the other in theirs
    home = cells.filter("side = source").select(*keys, "side", "rank", "cell")
    other = home.select(*keys, F.col("side").alias("_s"), F.col("rank").alias("partner"), "cell")
    pairs = home.join(other, [*keys, "cell"]).filter("side <> _s").groupBy(*keys, "side", "rank", "partner").agg(F.count(F.lit(1)).alias("n"))
    partner = pairs.groupBy(*keys, "side", "rank").agg(F.max_by("partner", F.struct("n", -F.col("partner"))).alias("partner"))
    out = found.join(shared, [*keys, "side", "rank"], "left").join(partner, [*keys, "side", "rank"], "left")
    return facts, out.select(*keys, "side", "rank", "id", "area_a_ha", "area_b_ha", "overlap", "partner")
