"""Flow forests as edge tables: accumulation, catchments, stream links, pools, site choice.

``flow(<keys>, cell, recv, …)`` holds one row per cell; ``recv`` is null at outlets. Downstream
sums use pointer doubling: every round each cell hands its totals to the cell its pointer names
and then points twice as far, so a river of n cells takes log2(n) joins.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.functions import terrain as T
from rillwork.operators.spatial import radius_join
from rillwork.session import attach, cut_sized


def accumulate(
    flow: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    minima: Mapping[str, Column] | None = None,
    step: Column | None = None,
    node: str = "cell",
    parent: str = "recv",
    max_rounds: int = 64,
) -> DataFrame:
    """Totals over everything upstream of each node, the node included.

    With ``step`` (length to the parent) the column ``longest`` is the longest upstream path.
    Since a catchment is everything upstream of its outlet, this gives every possible
    catchment's measures at once, nested ones included.
    """
    keys = list(keys)
    sums, maxima, minima = dict(sums or {}), dict(maxima or {}), dict(minima or {})
    cols = {**sums, **maxima, **minima}
    start = flow.select(
        *keys, F.col(node).alias("_v"), F.col(parent).alias("_p"),
        *[c.alias(n) for n, c in cols.items()],
        *([step.cast("double").alias("_d"), F.lit(0.0).alias("longest")] if step is not None else []),
    )
    state = cut_sized(start)
    at = [*keys, "_v"]
    for _ in range(max_rounds):
        live = state.filter(F.col("_p").isNotNull())
        if not live.limit(1).count():
            return state.drop("_p", "_d").withColumnRenamed("_v", node)
        aggs = [F.sum(n).alias(f"_g_{n}") for n in sums]
        aggs += [F.max(n).alias(f"_g_{n}") for n in maxima] + [F.min(n).alias(f"_g_{n}") for n in minima]
        if step is not None:
            aggs.append(F.max(F.col("longest") + F.col("_d")).alias("_g_longest"))
        given = live.groupBy(*keys, F.col("_p").alias("_v")).agg(*aggs)
        # the pointer's own pointer; rows whose pointer ends at an outlet are finished here
        far = state.filter(F.col("_p").isNotNull()).select(
            *keys, F.col("_v").alias("_p"), F.col("_p").alias("_pp"), *([F.col("_d").alias("_dd")] if step is not None else [])
        )
        # finished rows have no pointer; a key of their own keeps them from piling up as nulls
        spread = F.coalesce(F.col("_p"), -1 - F.col("_v"))
        far = far.withColumnRenamed("_p", "_k")
        moved = state.join(given, at, "left").withColumn("_k", spread).join(far, [*keys, "_k"], "left")
        new = [(F.col(n) + F.coalesce(f"_g_{n}", F.lit(0))).alias(n) for n in sums]
        new += [F.greatest(n, f"_g_{n}").alias(n) for n in maxima]
        new += [F.least(n, f"_g_{n}").alias(n) for n in minima]
        if step is not None:
            new += [(F.col("_d") + F.col("_dd")).alias("_d"), F.greatest("longest", "_g_longest").alias("longest")]
        state = cut_sized(moved.select(*at, F.col("_pp").alias("_p"), *new))
    raise RuntimeError("pointers did not settle: the flow table has a cycle")


def step_length(cols: Column, cell_size: Column | float) -> Column:
    """Length of the step from ``cell`` to ``recv``: the diagonal counts √2."""
    here, there = F.col("cell"), F.col("recv")
    diagonal = (F.floor(here / cols) != F.floor(there / cols)) & (here % cols != there % cols)
    size = cell_size if isinstance(cell_size, Column) else F.lit(float(cell_size))
    return size * F.when(diagonal, math.sqrt(2.0)).otherwise(1.0)


def roots(flow: DataFrame, keys: Sequence[str], outlets: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The first outlet at or below each cell, with the number of steps to it.

    ``outlets(<keys>, cell)``. Cells that reach no outlet are left out.
    """
    keys = list(keys)
    at = [*keys, "cell"]
    stop = outlets.select(*at).distinct().withColumn("_out", F.lit(True))
    s = flow.select(*at, "recv").join(stop, at, "left")
    s = s.join(stop.select(*keys, F.col("cell").alias("recv"), F.col("_out").alias("_near")), [*keys, "recv"], "left")
    is_out = F.col("_out").isNotNull()
    state = cut_sized(
        s.select(
            *at,
            F.when(is_out, F.col("cell")).otherwise(F.col("recv")).alias("_p"),
            F.when(is_out, 0).otherwise(1).cast("long").alias("steps"),
            (is_out | F.col("_near").isNotNull()).alias("_done"),
        ).filter(F.col("_p").isNotNull())
    )
    for _ in range(max_rounds):
        if not state.filter("not _done").limit(1).count():
            return state.select(*at, F.col("_p").alias("outlet"), "steps")
        far = state.select(*keys, F.col("cell").alias("_k"), F.col("_p").alias("_pp"), F.col("steps").alias("_ss"), F.col("_done").alias("_dd"))
        # one join for all rows, finished ones under keys of their own: a union of both kinds would add its partitions up every round
        moved = state.withColumn("_k", F.when(F.col("_done"), -1 - F.col("cell")).otherwise(F.col("_p"))).join(far, [*keys, "_k"], "left")
        moved = moved.filter(F.col("_done") | F.col("_pp").isNotNull())  # dead ends drop out
        state = cut_sized(
            moved.select(
                *at, F.coalesce("_pp", "_p").alias("_p"), (F.col("steps") + F.coalesce("_ss", F.lit(0))).alias("steps"),
                (F.col("_done") | F.coalesce("_dd", F.lit(False))).alias("_done"),
            )
        )
    raise RuntimeError("pointers did not settle: the flow table has a cycle")


def catchment_edges(flow: DataFrame, keys: Sequence[str], outlets: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(<keys>, cell, edges)``: cell sides on the outline of every outlet's catchment, holes included.

    ``flow`` needs ``row, col, cell, recv``. Nested catchments are not listed cell by cell. Each cell belongs to
    its first outlet downstream, and two neighbouring cells lie in the same catchments from the outlet on where
    their outlets' ways meet. So side pairs are counted by outlet pair, the few different pairs find their
    meeting point by doubled jumps along the outlets, and the counts are summed downstream.
    """
    keys = list(keys)
    cells = flow.select(*keys, "row", "col", "cell")
    zone = cut_sized(roots(flow, keys, outlets).join(cells, [*keys, "cell"]).select(*keys, "row", "col", "cell", F.col("outlet").alias("zone")))
    shifted = zone.select(
        *keys, F.inline(F.array(F.struct(F.col("row"), (F.col("col") + 1).alias("col")), F.struct((F.col("row") + 1).alias("row"), F.col("col")))), F.col("zone").alias("b")
    )
    beside = zone.select(*keys, "row", "col", F.col("zone").alias("a")).join(shifted, [*keys, "row", "col"])
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = cut_sized(beside.groupBy(*keys, *pair).agg(F.count("*").alias("n")))
    below = zone.select(*keys, F.col("cell").alias("recv"), F.col("zone").alias("next"))
    tops = outlets.select(*keys, "cell").distinct().join(flow.select(*keys, "cell", "recv"), [*keys, "cell"])
    tree = cut_sized(tops.join(below, [*keys, "recv"], "left").select(*keys, F.col("cell").alias("x"), "next"))
    jumps, depth = [], tree.select(*keys, "x", F.col("next").alias("p"), F.col("next").isNotNull().cast("long").alias("d"))
    for _ in range(max_rounds):
        depth = cut_sized(depth)
        if depth.where("p is not null").isEmpty():
            break
        jumps.append(depth.select(*keys, "x", "p"))
        far = depth.select(*keys, F.col("x").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        depth = depth.join(far, [*keys, "p"], "left").select(*keys, "x", F.col("pp").alias("p"), (F.col("d") + F.coalesce("dd", F.lit(0))).alias("d"))
    else:
        raise RuntimeError("pointers did not settle: the flow table has a cycle")
    met = pairs.where("a <> b")
    for side in ("a", "b"):
        met = met.join(depth.select(*keys, F.col("x").alias(side), F.col("d").alias(f"d{side}")), [*keys, side])
    # the deeper one climbs to the depth of the other, then both climb while they differ
    deep, high = (F.when(F.col("da") >= F.col("db"), F.col(c)).otherwise(F.col(o)) for c, o in (("a", "b"), ("b", "a")))
    met = cut_sized(met.select(*keys, deep.alias("a"), high.alias("b"), F.abs(F.col("da") - F.col("db")).alias("gap"), "n"))
    for k, jump in reversed(list(enumerate(jumps))):
        met = met.join(jump.select(*keys, F.col("x").alias("a"), "p"), [*keys, "a"], "left")
        goes = F.col("gap") >= (1 << k)
        met = cut_sized(met.select(*keys, F.when(goes, F.col("p")).otherwise(F.col("a")).alias("a"), "b", F.when(goes, F.col("gap") - (1 << k)).otherwise(F.col("gap")).alias("gap"), "n"))
    for jump in reversed(jumps):
        for side in ("a", "b"):
            met = met.join(jump.select(*keys, F.col("x").alias(side), F.col("p").alias(f"p{side}")), [*keys, side], "left")
        goes = ~F.col("pa").eqNullSafe(F.col("pb"))
        met = cut_sized(met.select(*keys, *[F.when(goes, F.col(f"p{c}")).otherwise(F.col(c)).alias(c) for c in ("a", "b")], "n"))
    up = tree.select(*keys, F.col("x").alias("a"), "next")
    met = met.join(up, [*keys, "a"], "left").select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("next")).alias("x"), "n")
    inner = pairs.where("a = b").select(*keys, F.col("a").alias("x"), "n").unionByName(met.where("x is not null"))
    inner = inner.groupBy(*keys, "x").agg(F.sum("n").alias("inner"))
    size = zone.groupBy(*keys, F.col("zone").alias("x")).agg(F.count("*").alias("cells"))
    own = tree.join(size, [*keys, "x"], "left").join(inner, [*keys, "x"], "left")
    total = accumulate(own, keys, {"cells": F.coalesce("cells", F.lit(0)), "inner": F.coalesce("inner", F.lit(0))}, node="x", parent="next")
    return total.select(*keys, F.col("x").alias("cell"), (4 * F.col("cells") - 2 * F.col("inner")).alias("edges"))


def upstream_cells(flow: DataFrame, keys: Sequence[str], outlets: DataFrame) -> DataFrame:
    """``(outlet, cell)`` for every cell upstream of each outlet, nested outlets included.

    Cells get their nearest outlet by doubling; the outlets' own chain (one row per outlet)
    then lifts them to the outlets further down.
    """
    keys = list(keys)
    near = cut_sized(roots(flow, keys, outlets))
    # the next outlet below each outlet: where its receiver drains to
    tops = outlets.select(*keys, F.col("cell")).distinct()
    below = (
        tops.join(flow.select(*keys, "cell", "recv"), [*keys, "cell"])
        .join(near.select(*keys, F.col("cell").alias("recv"), F.col("outlet").alias("next")), [*keys, "recv"])
        .select(*keys, F.col("cell").alias("outlet"), "next")
    )
    below = cut_sized(below)
    chain = cut_sized(tops.select(*keys, F.col("cell").alias("outlet"), F.col("cell").alias("top")))
    front = chain
    parts = [chain]
    while True:
        front = cut_sized(
            front.join(below.withColumnRenamed("outlet", "top"), [*keys, "top"]).select(
                *keys, "outlet", F.col("next").alias("top")
            )
        )
        if not front.limit(1).count():
            break
        parts.append(front)
    lifted = parts[0]
    for p in parts[1:]:
        lifted = lifted.unionByName(p)
    return near.join(lifted, [*keys, "outlet"]).select(*keys, F.col("top").alias("outlet"), "cell")


def stream_cells(flow: DataFrame, min_area: float, cell_area: float) -> DataFrame:
    """Channel cells: accumulation at least the area threshold, never under 10 cells."""
    cells = max(10, round(min_area / cell_area))
    return flow.filter(F.col("acc") >= cells)


def stream_links(stream: DataFrame, keys: Sequence[str], max_rounds: int = 64) -> DataFrame:
    """Cells of every channel link, ``link`` (its head cell) and ``pos`` from the head down.

    A head has no or several channel donors; the link runs to the next junction, which it
    includes, or to the end of the channel. ``stream(<keys>, cell, recv, acc)``.
    """
    keys = list(keys)
    s = stream.select(*keys, "cell", "recv", "acc")
    inside = s.select(*keys, F.col("cell").alias("recv"), F.lit(1).alias("_in"))
    s = s.join(inside, [*keys, "recv"], "left").withColumn("recv", F.when(F.col("_in") == 1, F.col("recv"))).drop("_in")
    donors = s.filter(F.col("recv").isNotNull()).groupBy(*keys, F.col("recv").alias("cell")).agg(
        F.count(F.lit(1)).alias("donors"), F.min("cell").alias("_only")
    )
    s = cut_sized(s.join(donors, [*keys, "cell"], "left").withColumn("donors", F.coalesce("donors", F.lit(0))))
    # walk up single-donor runs: the pointer is the only donor, heads point at themselves
    head = F.col("donors") != 1
    state = s.select(
        *keys, "cell",
        F.when(head, F.col("cell")).otherwise(F.col("_only")).alias("_p"),
        F.when(head, 0).otherwise(1).cast("long").alias("pos"),
        head.alias("_done"),
    )
    state = cut_sized(state)
    for _ in range(max_rounds):
        if not state.filter("not _done").limit(1).count():
            break
        far = state.select(
            *keys, F.col("cell").alias("_p"), F.col("_p").alias("_pp"), F.col("pos").alias("_s"), F.col("_done").alias("_dd")
        )
        todo = state.filter("not _done").join(far, [*keys, "_p"]).select(
            *keys, "cell", F.col("_pp").alias("_p"), (F.col("pos") + F.col("_s")).alias("pos"), F.col("_dd").alias("_done")
        )
        state = cut_sized(state.filter("_done").unionByName(todo))
    else:
        raise RuntimeError("links did not settle")
    body = state.select(*keys, F.col("_p").alias("link"), "pos", "cell").join(
        s.select(*keys, "cell", "recv", "acc", "donors"), [*keys, "cell"]
    )
    body = cut_sized(body)
    junction = s.filter("donors <> 1").select(*keys, F.col("cell").alias("recv"), F.col("acc").alias("_acc"))
    mouth = body.join(junction, [*keys, "recv"]).select(
        *keys, "link", (F.col("pos") + 1).alias("pos"), F.col("recv").alias("cell"), F.col("_acc").alias("acc")
    )
    return body.select(*keys, "link", "pos", "cell", "acc").unionByName(mouth)


def link_table(cells: DataFrame, keys: Sequence[str], cols: Column, cell_size: float) -> DataFrame:
    """One row per link: head, mouth, cell count, length in metres, accumulation at both ends."""
    keys = list(keys)
    w = W.partitionBy(*keys, "link").orderBy("pos")
    prev = F.lag("cell").over(w)
    diagonal = (F.floor(F.col("cell") / cols) != F.floor(F.col("_prev") / cols)) & (
        F.col("cell") % cols != F.col("_prev") % cols
    )
    step = F.when(F.col("_prev").isNull(), 0.0).when(diagonal, cell_size * math.sqrt(2.0)).otherwise(cell_size)
    return (
        cells.withColumn("_prev", prev)
        .groupBy(*keys, "link")
        .agg(
            F.max_by("cell", "pos").alias("mouth"),
            F.count(F.lit(1)).alias("cells"),
            F.sum(step).alias("length_m"),
            F.min_by("acc", "pos").alias("acc_head"),
            F.max_by("acc", "pos").alias("acc_mouth"),
        )
    )


def strahler(links: DataFrame, keys: Sequence[str], max_order: int = 40) -> DataFrame:
    """Add ``ord``: sources are 1, two equal highest feeders raise the order by one.

    Order ``k + 1`` holds exactly downstream of a link with two feeders of order ``k`` or more,
    so each order is one downstream closure over the links table.
    """
    keys = list(keys)
    ln = cut_sized(links.select(*keys, "link", "mouth"))
    heads = ln.select(*keys, F.col("link").alias("mouth"), F.lit(True).alias("_head"))
    down = ln.join(heads, [*keys, "mouth"], "left")
    follows = F.col("_head") & (F.col("mouth") != F.col("link"))
    down = cut_sized(down.select(*keys, "link", F.when(follows, F.col("mouth")).alias("next")))
    orders = down.select(*keys, "link", F.lit(1).alias("ord"))
    level = down.select(*keys, "link")
    for k in range(2, max_order):
        pairs = (
            down.filter(F.col("next").isNotNull())
            .join(level, [*keys, "link"], "left_semi")
            .groupBy(*keys, F.col("next").alias("link"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter("_n >= 2")
        )
        pairs = cut_sized(pairs.select(*keys, "link"))
        if not pairs.limit(1).count():
            return links.join(orders.groupBy(*keys, "link").agg(F.max("ord").alias("ord")), [*keys, "link"])
        flagged = down.join(pairs.withColumn("_j", F.lit(1)), [*keys, "link"], "left")
        closed = accumulate(
            flagged.withColumn("_j", F.coalesce("_j", F.lit(0))), keys, maxima={"hit": F.col("_j")}, node="link", parent="next"
        )
        level = cut_sized(closed.filter("hit = 1").select(*keys, "link"))
        orders = orders.unionByName(level.select(*keys, "link", F.lit(k).alias("ord")))
    raise RuntimeError("more stream orders than max_order")


def snap_to_channel(
    points: DataFrame, flow: DataFrame, keys: Sequence[str], radius_m: float, min_area: float, cell_size: float
) -> DataFrame:
    """Nearest cell with enough upstream area for each point, the larger channel on ties.

    ``points(<keys>, point, row, col)``; points without such a cell within the radius get nulls,
    so a caller can widen the radius for exactly those.
    """
    keys = list(keys)
    need = max(1, round(min_area / cell_size**2))
    channel = flow.filter(F.col("acc") >= need).select(*keys, "row", "col", "cell", "acc")
    near = radius_join(
        points.select(*keys, "point", "row", "col"), channel, ("row", "col"), keys, radius_m / cell_size + 1e-9
    )
    dist = F.hypot((F.col("row_place") - F.col("row")) * F.lit(cell_size), (F.col("col_place") - F.col("col")) * F.lit(cell_size))
    score = F.struct((dist - 1e-6 * F.col("acc")).alias("s"), F.col("cell"))
    best = near.groupBy(*keys, "point").agg(
        F.min_by(F.struct("cell", F.col("row_place").alias("snap_row"), F.col("col_place").alias("snap_col"), "acc", dist.alias("distance_m")), score).alias("_b")
    )
    return points.join(best, [*keys, "point"], "left").select(points["*"], "_b.*")


def stream_totals(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links, total length and highest order per raster."""
    return links.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("links"), F.sum("length_m").alias("length_m"), F.max("ord").alias("max_order")
    )


def snap_anywhere(
    points: DataFrame, flow: DataFrame, keys: Sequence[str], radius_m: float, min_area: float, cell_size: float,
    max_doublings: int = 40,
) -> DataFrame:
    """Snap within the radius, else to the best channel cell of the whole raster.

    The radius doubles for points still open. A find is final once no cell further out could
    score better, whatever its accumulation. Points of rasters without any channel keep nulls.
    """
    keys = list(keys)
    first = cut_sized(snap_to_channel(points, flow, keys, radius_m, min_area, cell_size))
    need = max(1, round(min_area / cell_size**2))
    channel = flow.filter(F.col("acc") >= need).select(*keys, "row", "col", "cell", "acc")
    facts = cut_sized(channel.groupBy(*keys).agg(F.max("acc").alias("_most")))
    todo = cut_sized(attach(first.filter(F.col("cell").isNull()).select(points["*"]), facts, keys))
    out = first.filter(F.col("cell").isNotNull())
    missing = first.filter(F.col("cell").isNull()).join(facts, keys, "left_anti")
    radius = radius_m
    for _ in range(max_doublings):
        if not todo.limit(1).count():
            return out.unionByName(missing)
        radius *= 2
        got = snap_to_channel(todo, channel, keys, radius, min_area, cell_size)
        score = F.col("distance_m") - 1e-6 * F.col("acc")
        sure = F.coalesce(score <= radius - 1e-6 * F.col("_most"), F.lit(False))
        got = cut_sized(got.withColumn("_sure", sure))
        out = out.unionByName(got.filter("_sure").drop("_sure", "_most"))
        todo = cut_sized(got.filter("not _sure").select(*todo.columns))
    raise RuntimeError("points are still far from every channel; raise max_doublings")


def suppress_near(scored: DataFrame, keys: Sequence[str], radius: float, top_n: int) -> DataFrame:
    """Best first, then drop everything strictly closer than ``radius``; at most ``top_n`` per key.

    Each round takes the best live point of every key at once (a map-side maximum) and filters
    the rest against that one row per key, so no pairs of points are ever built.
    ``scored(<keys>, id, row, col, score)``; the smaller id wins equal scores.
    """
    keys = list(keys)
    live = cut_sized(scored.select(*keys, "id", "row", "col", "score"))
    kept = None
    for rank in range(1, top_n + 1):
        top = F.max_by(F.struct("id", "row", "col", "score"), F.struct(F.col("score"), -F.col("id")))
        best = cut_sized(live.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t.*", F.lit(rank).alias("rank")))
        if not best.limit(1).count():
            break
        kept = best if kept is None else kept.unionByName(best)
        spot = best.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"))
        away = F.hypot(F.col("row") - F.col("_r"), F.col("col") - F.col("_c")) >= radius
        live = attach(live, spot, keys).filter(away).drop("_r", "_c")
    return kept if kept is not None else live.withColumn("rank", F.lit(1))


def normalise(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Min-max each ``{out: column}`` over the rows of its key; 0 where the span vanishes."""
    keys = list(keys)
    spans = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{o}") for o, c in columns.items()],
        *[F.max(c).alias(f"_hi_{o}") for o, c in columns.items()],
    )
    out = attach(df, spans, keys)
    for o, c in columns.items():
        lo, hi = F.col(f"_lo_{o}"), F.col(f"_hi_{o}")
        out = out.withColumn(o, F.when(hi - lo < 1e-12, 0.0).otherwise((F.col(c) - lo) / (hi - lo))).drop(lo, hi)
    return out


#: Upstream area in hectares (too small, good from, good to, a river) and weights.
AREA_HA = (1.0, 10.0, 150.0, 1000.0)
SITE_WEIGHTS = {"upstream_area": 0.35, "flatness": 0.20, "wetness": 0.15, "impoundment": 0.30}


def site_flags(
    cells: DataFrame, keys: Sequence[str], rows: Column, cols: Column, cell_area: float,
    max_slope: float = 15.0, margin: int = 3, belt_m: float = 200.0, area_ha=AREA_HA,
) -> DataFrame:
    """Flag columns of the site rules on channel cells and the final ``eligible``.

    ``cells`` needs ``stream, slope_pct, acc, fed, dist_major`` (metres to the nearest channel
    beyond the good area band, null when none is near) and optionally ``inside``, ``water``.
    """
    ha = F.col("acc") * cell_area / 1e4
    wet = F.col("water") if "water" in cells.columns else F.lit(False)
    inside = F.col("inside") if "inside" in cells.columns else F.lit(True)
    c = cells.withColumn("river", (F.col("stream") & (ha >= area_ha[3])) | wet)
    c = c.withColumn("belt", F.coalesce(F.col("dist_major") < belt_m, F.lit(False)))
    edge = (
        (F.col("row") < margin) | (F.col("row") >= rows - margin) | (F.col("col") < margin) | (F.col("col") >= cols - margin)
    )
    ok = F.col("stream") & (F.col("slope_pct") <= max_slope) & ~F.col("river")
    c = c.withColumn("_ok", ok).withColumn("_base", F.col("_ok") & ~F.col("belt") & ~edge & inside)
    whole = c.groupBy(*keys).agg(
        # without any candidate no catchment is cut off
        (F.max(F.col("_base") & ~F.col("fed")) | ~F.max("_base")).alias("complete")
    )
    c = attach(c, whole, list(keys))
    return c.withColumn("eligible", F.col("_base") & (~F.col("complete") | ~F.col("fed")))


def site_counts(flagged: DataFrame, keys: Sequence[str], cell_area: float) -> DataFrame:
    """How many cells each rule removed, per raster."""
    return flagged.groupBy(*keys).agg(
        F.count(F.when(F.col("eligible"), 1)).alias("considered"),
        (
            F.count(F.when(F.col("_ok") & F.col("belt"), 1)) + F.count(F.when(F.col("river") & F.col("stream"), 1))
        ).alias("river_cells"),
        F.count(F.when(F.col("_base") & F.col("fed") & F.col("complete"), 1)).alias("edge_fed_cells"),
        F.coalesce(F.max(F.when(F.col("stream"), F.col("acc") * cell_area / 1e4)), F.lit(0.0)).alias("max_area_ha"),
        F.max("complete").alias("catchments_complete"),
    )


def site_scores(eligible: DataFrame, keys: Sequence[str], cell_area: float, weights=None, area_ha=AREA_HA) -> DataFrame:
    """Criterion values and weighted score of eligible cells (``volume_m3``, ``area_m2`` joined in)."""
    weights = weights or SITE_WEIGHTS
    ha = F.col("acc").cast("double") * cell_area / 1e4
    bounds = [math.log10(b) for b in area_ha]
    eff = F.when(F.col("area_m2") > 0, F.col("volume_m3") / F.greatest(F.col("area_m2"), F.lit(1e-9))).otherwise(0.0)
    e = eligible.withColumn("efficiency", eff).withColumns(
        {
            "s_upstream_area": T.through(F.log10(F.greatest(ha, F.lit(1e-3))), T.hill(bounds)),
            "s_flatness": T.plateau(F.col("slope_pct")),
        }
    )
    e = normalise(e, keys, {"s_wetness": "twi", "s_impoundment": "efficiency"})
    return e.withColumn("score", T.weighted_score(weights, {k: F.col(f"s_{k}") for k in weights}))
