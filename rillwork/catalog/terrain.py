"""Raster terrain over ``part`` read as a dense 40-column grid, with SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rillwork.catalog.base import query, table
from rillwork.catalog.climate import rnd
from rillwork.functions import terrain as T
from rillwork.operators import flow as FL
from rillwork.operators import focal as FO
from rillwork.operators import ordered as O
from rillwork.operators import pools as PL
from rillwork.operators import spatial as S
from rillwork.operators import tiles as TI
from rillwork.session import cut

K = ["raster"]
WIDTH, CELL = 40, 10.0


def cols():
    return F.lit(WIDTH).cast("long")


def grid(spark, d):
    """Cells: height from price and size, class and mask from the size."""
    return table(spark, d, "part").select(
        F.lit("g").alias("raster"),
        F.floor(F.col("p_partkey") / WIDTH).cast("int").alias("row"),
        (F.col("p_partkey") % WIDTH).cast("int").alias("col"),
        (F.col("p_retailprice") + F.col("p_size") * 0.5).alias("z"),
        F.col("p_size").alias("size"),
        F.col("p_partkey").alias("cell"),
    )


G = """g AS (SELECT CAST(p_partkey//40 AS INTEGER) AS row, CAST(p_partkey%40 AS INTEGER) AS col, p_retailprice+p_size*0.5 AS z,
      p_size AS size, p_partkey AS cell FROM part)"""
_OFF = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def nb_sql(src: str = "g", out: str = "nb", value: str = "z") -> str:
    """CTE with the eight neighbours of ``src``."""
    joins = " ".join(
        f"LEFT JOIN {src} {k}_ ON {k}_.row=c.row+({r}) AND {k}_.col=c.col+({q})" for k, (r, q) in _OFF.items()
    )
    return f"{out} AS (SELECT c.*, {', '.join(f'{k}_.{value} AS {k}' for k in _OFF)} FROM {src} c {joins})"


_EF = """ef AS (SELECT row, col, cell, z, coalesce(nw,w,n,z) AS nw, coalesce(n,z) AS n, coalesce(ne,e,n,z) AS ne, coalesce(w,z) AS w,
      coalesce(e,z) AS e, coalesce(sw,w,s,z) AS sw, coalesce(s,z) AS s, coalesce(se,e,s,z) AS se FROM nb)"""
_SLOPE = """gr AS (SELECT *, ((ne+2*e+se)-(nw+2*w+sw))/80.0::DOUBLE AS dx, ((nw+2*n+ne)-(sw+2*s+se))/80.0::DOUBLE AS dy FROM ef),
    sf AS (SELECT *, sqrt(dx*dx+dy*dy) AS hyp, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope FROM gr)"""
SURF = f"{G}, {nb_sql()}, {_EF}, {_SLOPE}"


def surfaces(cells, cell=CELL):
    """Slope, aspect, shade, curvature and the gradients of a height grid."""
    nb = FO.neighbours(cells, K)
    ef = T.edge_filled()
    size = F.lit(float(cell))
    dx, dy = T.gradients(ef, size)
    nb = nb.withColumns({"dx": dx, "dy": dy})
    dx, dy = F.col("dx"), F.col("dy")
    prof, plan = T.curvatures(ef, F.col("z"), size)
    return nb.withColumns(
        {
            "slope": T.slope_deg(dx, dy), "aspect": T.aspect_deg(dx, dy), "shade": T.hillshade(dx, dy),
            "profile": prof, "plan": plan,
        }
    ).drop("_tr", "_tc", *T.SIDES)


_CURV = """cv AS (SELECT *, ((w+e)/2-z)/100 AS cd, ((n+s)/2-z)/100 AS ce, (-nw+ne+sw-se)/400 AS cf, (-w+e)/20 AS cg, (n-s)/20 AS ch FROM sf)"""


@query(
    "terrain_surfaces",
    f"""WITH {SURF}, {_CURV} SELECT row, col, round(slope,6) AS slope,
    CASE WHEN hyp>=1e-9 THEN round(CASE WHEN degrees(atan2(dx,dy))<0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END,6) END AS aspect,
    round_even(1+254*least(greatest(cos(radians(45))*cos(atan(hyp))+sin(radians(45))*sin(atan(hyp))*cos(radians(315)-atan2(dx,dy)),0),1),0) AS shade,
    CASE WHEN cg*cg+ch*ch<1e-12 THEN 0 ELSE round(-2*(cd*cg*cg+ce*ch*ch+cf*cg*ch)/(cg*cg+ch*ch)*100,6)+0 END AS profile,
    CASE WHEN cg*cg+ch*ch<1e-12 THEN 0 ELSE round(-2*(cd*ch*ch+ce*cg*cg-cf*cg*ch)/(cg*cg+ch*ch)*100,6)+0 END AS plan FROM cv""",
)
def terrain_surfaces(spark, d):
    s = surfaces(grid(spark, d)).select("row", "col", "slope", "aspect", "shade", "profile", "plan")
    s = rnd(s, 6)
    return s.withColumn("profile", F.col("profile") + 0.0).withColumn("plan", F.col("plan") + 0.0)


@query(
    "elevation_statistics",
    f"WITH {SURF} SELECT min(z) AS z_min, max(z) AS z_max, round(avg(z),6) AS z_mean, round(max(z)-min(z),6) AS relief, round(avg(slope),6) AS mean_slope FROM sf",
)
def elevation_statistics(spark, d):
    z = F.col("z")
    return surfaces(grid(spark, d)).groupBy("raster").agg(
        F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.round(F.avg(z), 6).alias("z_mean"),
        F.round(F.max(z) - F.min(z), 6).alias("relief"), F.round(F.avg("slope"), 6).alias("mean_slope"),
    ).drop("raster")


@query(
    "display_stretch",
    f"""WITH {SURF} SELECT round(quantile_cont(slope,0.02),6) AS lo, round(CASE WHEN quantile_cont(slope,0.98)<=quantile_cont(slope,0.02)
    THEN quantile_cont(slope,0.02)+1 ELSE quantile_cont(slope,0.98) END,6) AS hi FROM sf""",
)
def display_stretch(spark, d):
    p = O.percentiles_linear(surfaces(grid(spark, d)), K, "slope", {"lo": 0.02, "hi": 0.98})
    hi = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))
    return p.select(F.round("lo", 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    "neighbour_counts",
    f"""WITH {G} SELECT c.cell, count(*) FILTER (abs(o.row-c.row)+abs(o.col-c.col)=1) AS sides, count(*) AS around FROM g c JOIN g o
    ON o.row BETWEEN c.row-1 AND c.row+1 AND o.col BETWEEN c.col-1 AND c.col+1 AND o.cell<>c.cell GROUP BY 1""",
)
def neighbour_counts(spark, d):
    g = grid(spark, d)
    pairs = FO.neighbour_pairs(g.select("row", "col", "cell"))
    other = g.select(F.col("row").alias("row2"), F.col("col").alias("col2"))
    side = (F.abs(F.col("row") - F.col("row2")) + F.abs(F.col("col") - F.col("col2"))) == 1
    return pairs.join(other, ["row2", "col2"]).groupBy("cell").agg(
        F.count(F.when(side, 1)).alias("sides"), F.count(F.lit(1)).alias("around")
    )


def _blur_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    w = ",".join(f"({k},{x / sum(raw)!r}::DOUBLE)" for k, x in zip(range(-r, r + 1), raw))
    return f"""w(k,wt) AS (VALUES {w}), mx AS (SELECT max(row) AS mr, max(col) AS mc FROM g),
    b1 AS (SELECT g.row, g.col, sum(wt*o.z) AS z FROM g CROSS JOIN w CROSS JOIN mx JOIN g o ON o.col=g.col AND o.row=least(greatest(g.row+k,0),mr) GROUP BY 1,2),
    b2 AS (SELECT b.row, b.col, sum(wt*o.z) AS z FROM b1 b CROSS JOIN w CROSS JOIN mx JOIN b1 o ON o.row=b.row AND o.col=least(greatest(b.col+k,0),mc) GROUP BY 1,2)"""


@query("gaussian_smoothing", f"WITH {G}, {_blur_sql(0.7)} SELECT row, col, round(z,6) AS z FROM b2")
def gaussian_smoothing(spark, d):
    return FO.blur(grid(spark, d), K, "z", 0.7).select("row", "col", F.round("z", 6).alias("z"))


def _morph_sql(src: str, steps: str, value: str = "m") -> str:
    parts, at = [], src
    for i, s in enumerate(steps):
        fn = "min" if s == "-" else "max"
        parts.append(
            f"""mo{i} AS (SELECT c.row, c.col, c.cell, {fn}(o.{value}) AS {value} FROM {at} c JOIN {at} o ON abs(o.row-c.row)+abs(o.col-c.col)<=1
            AND o.row BETWEEN c.row-1 AND c.row+1 GROUP BY 1,2,3)"""
        )
        at = f"mo{i}"
    return ", ".join(parts)


_MASK = f"{G}, mk AS (SELECT row, col, cell, CASE WHEN size>20 THEN 1 ELSE 0 END AS m FROM g)"


@query("morphological_open_close", f"WITH {_MASK}, {_morph_sql('mk', '-++-')} SELECT row, col, m FROM mo3")
def morphological_open_close(spark, d):
    m = grid(spark, d).withColumn("m", F.when(F.col("size") > 20, 1).otherwise(0))
    return FO.open_close(m.select("raster", "row", "col", "cell", "m"), K, "m").select("row", "col", "m")


_SEG = {
    1: ["LW"], 14: ["LW"], 2: ["WR"], 13: ["WR"], 3: ["LR"], 12: ["LR"], 4: ["TR"], 11: ["TR"],
    6: ["TW"], 9: ["TW"], 7: ["LT"], 8: ["LT"], 5: ["LT", "WR"], 10: ["LW", "TR"],
}
_PT = {
    "T": ("row::DOUBLE", "col+(lv-a)/(b-a)"), "R": ("row+(lv-b)/(c-b)", "col+1.0::DOUBLE"),
    "W": ("row+1.0::DOUBLE", "col+(lv-d)/(c-d)"), "L": ("row+(lv-a)/(d-a)", "col::DOUBLE"),
}
_ISO = " UNION ALL ".join(
    f"SELECT lv AS level, row, col, round({_PT[p[0]][0]},6) AS r0, round({_PT[p[0]][1]},6) AS c0, round({_PT[p[1]][0]},6) AS r1, round({_PT[p[1]][1]},6) AS c1 FROM cs WHERE cse={k}"
    for k, ps in _SEG.items()
    for p in ps
)


@query(
    "isoline_segments",
    f"""WITH {G}, {nb_sql()}, bl AS (SELECT row, col, z AS a, e AS b, se AS c, s AS d FROM nb WHERE se IS NOT NULL),
    lv AS (SELECT *, unnest(range(CAST(ceil(least(a,b,c,d)/7) AS BIGINT), CAST(floor(greatest(a,b,c,d)/7) AS BIGINT)+1))*7.0::DOUBLE AS lv FROM bl),
    cs AS (SELECT *, (CASE WHEN a>=lv THEN 8 ELSE 0 END)+(CASE WHEN b>=lv THEN 4 ELSE 0 END)+(CASE WHEN c>=lv THEN 2 ELSE 0 END)+(CASE WHEN d>=lv THEN 1 ELSE 0 END) AS cse FROM lv)
    {_ISO}""",
)
def isoline_segments(spark, d):
    return rnd(FO.isoline_segments(grid(spark, d), K, 7.0).drop("raster"), 6)


def flow(spark, d, value="z", surface=None):
    """Direction and receiver of the grid's cells (unfilled: pits are outlets)."""
    return FO.flow_direction((surface if surface is not None else grid(spark, d)).drop("cell"), K, cols(), value)


_D8 = [("e", 0, 1, 1), ("se", 1, 1, 2), ("s", 1, 0, 4), ("sw", 1, -1, 8), ("w", 0, -1, 16), ("nw", -1, -1, 32), ("n", -1, 0, 64), ("ne", -1, 1, 128)]
_SL = ", ".join(f"coalesce((z-{k})/{'sqrt(2.0::DOUBLE)' if r and c else '1.0::DOUBLE'},0) AS s_{k}" for k, r, c, _ in _D8)


def flow_sql(src: str = "g") -> str:
    """CTEs ending in ``fl``: cell, recv, dir, rim."""
    return f"""{nb_sql(src)}, sl AS (SELECT *, {_SL} FROM nb), be AS (SELECT *, greatest({",".join("s_" + k for k, *_ in _D8)}) AS best FROM sl),
    fl AS (SELECT row, col, cell, z, CASE WHEN best>0 THEN CASE {" ".join(f"WHEN s_{k}=best THEN {v}" for k, _, _, v in _D8)} END ELSE 0 END AS dir,
      CASE WHEN best>0 THEN cell+CASE {" ".join(f"WHEN s_{k}=best THEN {r * WIDTH + c}" for k, r, c, _ in _D8)} END END AS recv,
      ({" OR ".join(f"{k} IS NULL" for k, *_ in _D8)}) AS rim FROM be)"""


WALK = f"""{flow_sql()}, wk AS (SELECT cell AS src, cell AS dst, 0.0::DOUBLE AS dist, 0 AS n FROM fl UNION ALL
      SELECT wk.src, fl.recv, dist+CASE WHEN fl.recv//40<>fl.cell//40 AND fl.recv%40<>fl.cell%40 THEN 10*sqrt(2.0::DOUBLE) ELSE 10.0 END, n+1
      FROM wk JOIN fl ON fl.cell=wk.dst WHERE fl.recv IS NOT NULL)"""


@query("flow_direction", f"WITH {G}, {flow_sql()} SELECT cell, recv, dir, rim FROM fl")
def flow_direction(spark, d):
    return flow(spark, d).select("cell", "recv", "dir", "rim")


def accumulated(spark, d):
    """Every cell's catchment measures."""
    f = flow(spark, d)
    return FL.accumulate(
        f, K,
        sums={"acc": F.lit(1).cast("long"), "size_sum": F.col("size").cast("long")},
        maxima={"fed": F.col("rim"), "z_max": F.col("z")},
        minima={"z_min": F.col("z")},
        step=FL.step_length(cols(), CELL),
    )


@query(
    "catchment_measures_everywhere",
    f"""WITH RECURSIVE {G}, {WALK} SELECT dst AS cell, count(*) AS acc, CAST(sum(g.size) AS BIGINT) AS size_sum, bool_or(fl.rim) AS fed, max(g.z) AS z_max, min(g.z) AS z_min,
    round(max(dist),6) AS longest FROM wk JOIN g ON g.cell=wk.src JOIN fl ON fl.cell=wk.src GROUP BY 1""",
)
def catchment_measures_everywhere(spark, d):
    return accumulated(spark, d).drop("raster").withColumn("longest", F.round("longest", 6))


_OUT = "SELECT cell FROM ac WHERE acc>=8"


@query(
    "upstream_cells_of_outlets",
    f"""WITH RECURSIVE {G}, {WALK}, ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1)
    SELECT dst AS outlet, src AS cell FROM wk WHERE dst IN ({_OUT})""",
)
def upstream_cells_of_outlets(spark, d):
    f = cut(flow(spark, d))
    acc = FL.accumulate(f, K, sums={"acc": F.lit(1).cast("long")})
    return FL.upstream_cells(f, K, acc.filter("acc >= 8").select("raster", "cell")).drop("raster")


_FILL = f"""{G}, {nb_sql()}, cn AS (SELECT cell, row, col, z, ({" OR ".join(f"{k} IS NULL" for k in _OFF)}) AS fixed FROM nb),
    ed AS (SELECT a.cell, b.cell AS o FROM cn a JOIN cn b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND b.cell<>a.cell WHERE NOT a.fixed),
    fi AS (SELECT 0 AS k, cell, CASE WHEN fixed THEN z ELSE 'inf'::DOUBLE END AS f FROM cn UNION ALL
      SELECT k+1, cell, f FROM (
        SELECT max(fi.k) AS k, ed.cell, CASE WHEN max(c.z)>min(fi.f) THEN max(c.z) ELSE min(fi.f)+0.0001::DOUBLE END AS f FROM fi JOIN ed ON ed.o=fi.cell JOIN cn c ON c.cell=ed.cell GROUP BY ed.cell
        UNION ALL SELECT fi.k, fi.cell, fi.f FROM fi JOIN cn c ON c.cell=fi.cell WHERE c.fixed) WHERE k<160),
    fd AS (SELECT cn.*, fi.f AS filled FROM fi JOIN cn USING (cell) WHERE k=160)"""


def filled(spark, d, tile=FO.TILE):
    return TI.fill_depressions(grid(spark, d), K, tile=tile)


@query(
    "fill_depressions",
    f"WITH RECURSIVE {_FILL} SELECT cell, round(filled,6) AS filled, round(filled-z,6) AS depth, filled-z>1.5*0.0001::DOUBLE AS changed FROM fd",
)
def fill_depressions(spark, d):
    f = filled(spark, d)
    return f.select(
        "cell", F.round("filled", 6).alias("filled"), F.round("depth", 6).alias("depth"), (F.col("depth") > 1.5e-4).alias("changed")
    )


MIN_CHANNEL = 10


def channel(spark, d):
    f = cut(flow(spark, d))
    acc = FL.accumulate(f, K, sums={"acc": F.lit(1).cast("long")})
    joined = cut(f.join(acc, [*K, "cell"]))
    return FL.stream_cells(joined, MIN_CHANNEL * CELL**2, CELL**2)


_STR = f"""{WALK}, ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1),
    st AS (SELECT ac.cell, ac.acc, CASE WHEN r.acc>={MIN_CHANNEL} THEN fl.recv END AS recv FROM ac JOIN fl ON fl.cell=ac.cell LEFT JOIN ac r ON r.cell=fl.recv WHERE ac.acc>={MIN_CHANNEL}),
    dn AS (SELECT st.*, (SELECT count(*) FROM st o WHERE o.recv=st.cell) AS donors FROM st),
    lk AS (SELECT cell AS link, 0 AS pos, cell, recv, acc, FALSE AS fin FROM dn WHERE donors<>1 UNION ALL
      SELECT lk.link, lk.pos+1, dn.cell, dn.recv, dn.acc, dn.donors<>1 FROM lk JOIN dn ON dn.cell=lk.recv WHERE NOT lk.fin),
    ll AS (SELECT link, max_by(cell,pos) AS mouth, count(*) AS cells, min_by(acc,pos) AS acc_head, max_by(acc,pos) AS acc_mouth FROM lk GROUP BY 1),
    ln AS (SELECT a.link, sum(CASE WHEN b.cell IS NULL THEN 0 WHEN a.cell//40<>b.cell//40 AND a.cell%40<>b.cell%40 THEN 10*sqrt(2.0::DOUBLE) ELSE 10 END) AS length_m
      FROM lk a LEFT JOIN lk b ON b.link=a.link AND b.pos=a.pos-1 GROUP BY 1)"""


@query("stream_link_cells", f"WITH RECURSIVE {G}, {_STR} SELECT link, CAST(pos AS BIGINT) AS pos, cell, acc FROM lk")
def stream_link_cells(spark, d):
    return FL.stream_links(channel(spark, d), K).drop("raster")


def links(spark, d):
    cells = cut(FL.stream_links(channel(spark, d), K))
    return FL.strahler(cut(FL.link_table(cells, K, cols(), CELL)), K)


_ORD = f"""{_STR}, sd AS (SELECT 0 AS k, link, 1 AS ord FROM ll UNION ALL
      SELECT k+1, link, CASE WHEN o IS NULL OR len(o)=0 THEN 1 WHEN len(list_filter(o, lambda x: x=list_max(o)))>=2 THEN list_max(o)+1 ELSE list_max(o) END FROM (
        SELECT max(sd.k) AS k, a.link, list(f.ord) FILTER (f.ord IS NOT NULL) AS o FROM ll a JOIN sd ON sd.link=a.link
        LEFT JOIN (SELECT ll.mouth, ll.link AS src, sd.ord FROM sd JOIN ll ON ll.link=sd.link) f ON f.mouth=a.link AND f.src<>a.link GROUP BY a.link) WHERE k<60),
    so AS (SELECT link, coalesce(ord,1) AS ord FROM sd WHERE k=60)"""


@query(
    "stream_links_with_order",
    f"""WITH RECURSIVE {G}, {_STR} SELECT ll.link, mouth, cells, round(length_m,6) AS length_m, acc_head, acc_mouth FROM ll JOIN ln USING (link)""",
)
def stream_links_with_order(spark, d):
    return rnd(links(spark, d).drop("raster", "ord"), 6)


@query("strahler_order", f"WITH RECURSIVE {G}, {_ORD} SELECT link, mouth, acc_head, ord FROM so JOIN ll USING (link)")
def strahler_order(spark, d):
    return links(spark, d).select("link", "mouth", "acc_head", "ord")


@query(
    "stream_totals",
    f"WITH RECURSIVE {G}, {_ORD} SELECT count(*) AS links, round(sum(length_m),4) AS length_m, max(ord) AS max_order, {MIN_CHANNEL} AS threshold_cells FROM ln JOIN so USING (link)",
)
def stream_totals(spark, d):
    return FL.stream_totals(links(spark, d), K).select(
        "links", F.round("length_m", 4).alias("length_m"), "max_order", F.lit(MIN_CHANNEL).alias("threshold_cells")
    )


def pour_points(spark, d):
    """One asked point per supplier, spread over the grid."""
    rows = table(spark, d, "part").count() // WIDTH  # from the Parquet footers
    return table(spark, d, "supplier").select(
        F.lit("g").alias("raster"), F.col("s_suppkey").alias("point"),
        ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.lit(rows)).cast("int").alias("row"),
        ((F.col("s_suppkey") * 3 + F.col("s_nationkey")) % WIDTH).cast("int").alias("col"),
    )


_PP = """pp AS (SELECT s_suppkey AS point, CAST((s_suppkey*7+s_nationkey)%(SELECT count(*)//40 FROM part) AS INTEGER) AS row, CAST((s_suppkey*3+s_nationkey)%40 AS INTEGER) AS col FROM supplier)"""
_SNAP = f"""{WALK}, ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1), {_PP},
    cd AS (SELECT point, ac.cell, acc, g.row AS snap_row, g.col AS snap_col, sqrt(pow((g.row-pp.row)*10.0::DOUBLE,2)+pow((g.col-pp.col)*10.0::DOUBLE,2)) AS dist
      FROM pp JOIN g ON g.row BETWEEN pp.row-4 AND pp.row+4 AND g.col BETWEEN pp.col-4 AND pp.col+4 JOIN ac ON ac.cell=g.cell WHERE acc>={MIN_CHANNEL}),
    sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dist-1e-6*acc, cell) AS rn FROM cd WHERE dist<=40+1e-9) WHERE rn=1)"""


@query(
    "snap_to_channel",
    f"WITH RECURSIVE {G}, {_SNAP} SELECT pp.point, pp.row, pp.col, sn.cell, snap_row, snap_col, acc, round(dist,6) AS distance_m FROM pp LEFT JOIN sn ON sn.point=pp.point",
)
def snap_to_channel(spark, d):
    acc = accumulated(spark, d).withColumn("row", F.floor(F.col("cell") / WIDTH).cast("int"))
    acc = cut(acc.withColumn("col", (F.col("cell") % WIDTH).cast("int")))
    got = FL.snap_to_channel(pour_points(spark, d), acc, K, 40.0, MIN_CHANNEL * 100.0, CELL)
    return rnd(got.drop("raster"), 6)


_FAR = f"""{_SNAP}, far AS (SELECT * FROM (SELECT pp.point, ac.cell, ac.acc, g.row AS snap_row, g.col AS snap_col, sqrt(pow((g.row-pp.row)*10.0::DOUBLE,2)+pow((g.col-pp.col)*10.0::DOUBLE,2)) AS dist,
      row_number() OVER (PARTITION BY pp.point ORDER BY sqrt(pow((g.row-pp.row)*10.0::DOUBLE,2)+pow((g.col-pp.col)*10.0::DOUBLE,2))-1e-6*ac.acc, ac.cell) AS rn FROM pp CROSS JOIN ac JOIN g ON g.cell=ac.cell
      WHERE ac.acc>={MIN_CHANNEL} AND pp.point NOT IN (SELECT point FROM sn)) WHERE rn=1),
    al AS (SELECT point, cell, acc, dist FROM sn UNION ALL SELECT point, cell, acc, dist FROM far)"""


@query("snap_anywhere", f"WITH RECURSIVE {G}, {_FAR} SELECT point, cell, acc, round(dist,6) AS distance_m FROM al")
def snap_anywhere(spark, d):
    acc = accumulated(spark, d).withColumn("row", F.floor(F.col("cell") / WIDTH).cast("int"))
    acc = cut(acc.withColumn("col", (F.col("cell") % WIDTH).cast("int")))
    got = FL.snap_anywhere(pour_points(spark, d), acc, K, 40.0, MIN_CHANNEL * 100.0, CELL)
    return rnd(got.select("point", "cell", "acc", "distance_m"), 6)


_ME = f"""me AS (SELECT dst AS cell, count(*) AS cells, max(g.z)-min(g.z) AS relief_m, max(dist) AS longest_m, bool_or(fl.rim) AS touches_edge, avg(sf.slope) AS mean_slope
      FROM wk JOIN g ON g.cell=wk.src JOIN fl ON fl.cell=wk.src JOIN sf ON sf.cell=wk.src GROUP BY 1),
    up AS (SELECT dst, src FROM wk WHERE dst IN (SELECT cell FROM al)),
    ie AS (SELECT a.dst AS cell, count(*) AS inside FROM up a JOIN up b ON b.dst=a.dst AND (b.src=a.src+{WIDTH} OR (b.src=a.src+1 AND b.src%{WIDTH}>0)) GROUP BY 1),
    ca AS (SELECT al.point, al.cell, al.dist, al.dist>40+1e-9 AS widened, me.* EXCLUDE (cell), cells*100.0::DOUBLE AS area_m2, (4*cells-2*coalesce(inside,0))*10.0::DOUBLE AS perimeter_m,
      least(greatest(100*(4*cells-2*coalesce(inside,0))/cells::DOUBLE,15),50) AS band_pct FROM al JOIN me USING (cell) LEFT JOIN ie USING (cell))"""


@query(
    "catchments_of_pour_points",
    f"""WITH RECURSIVE {G}, {_FAR}, {_EF}, {_SLOPE}, {_ME}
    SELECT point, cell AS outlet, round(dist,6) AS distance_m, widened, cells, area_m2, perimeter_m, round(band_pct,6) AS band_pct, round(relief_m,6) AS relief_m, round(longest_m,6) AS longest_m,
      round(mean_slope,6) AS mean_slope, touches_edge, NULL::VARCHAR AS reject FROM ca""",
)
def catchments_of_pour_points(spark, d):
    from rillwork.plans.terrain import catchments

    g = grid(spark, d).drop("cell")
    got = catchments(g, K, pour_points(spark, d), cols(), CELL, snap_m=40.0, min_area=MIN_CHANNEL * CELL**2)
    return rnd(got.drop("raster"), 6)


def masked(spark, d, cond="size > 30"):
    return grid(spark, d).filter(cond).select("raster", "row", "col", "cell")


def comp_sql(cond: str, out: str = "cp") -> str:
    """CTEs labelling the 8-connected groups of cells meeting ``cond``."""
    return f"""{out}m AS (SELECT row, col, cell FROM g WHERE {cond}),
    {out}e AS (SELECT a.cell, b.cell AS o FROM {out}m a JOIN {out}m b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1),
    {out}r AS (SELECT cell AS root, cell FROM {out}m UNION SELECT r.root, e.o FROM {out}r r JOIN {out}e e ON e.cell=r.cell),
    {out} AS (SELECT cell, min(root) AS label FROM {out}r GROUP BY 1)"""


@query(
    "connected_components",
    f"""WITH RECURSIVE {G}, {comp_sql("size>30")}, s AS (SELECT label, count(*) AS size FROM cp GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY label) AS number FROM s)
    SELECT cp.cell, cp.label, number, size FROM cp JOIN n USING (label)""",
)
def connected_components(spark, d):
    lab = cut(TI.label_components(masked(spark, d), K))
    num = TI.number_components(lab, K)
    return lab.join(num, [*K, "label"]).select("cell", "label", "number", "size")


@query(
    "large_components",
    f"""WITH RECURSIVE {G}, {comp_sql("size>30")}, s AS (SELECT label, count(*) AS n FROM cp GROUP BY 1)
    SELECT cell, label FROM cp JOIN s USING (label) WHERE n>=10""",
)
def large_components(spark, d):
    lab = cut(TI.label_components(masked(spark, d), K))
    return TI.keep_large(lab, K, 10).select("cell", "label")


@query(
    "mask_distance",
    f"""WITH {G}, m AS (SELECT row, col FROM g WHERE size>=48), p AS (SELECT g.cell, min(pow(g.row-m.row,2)+pow(g.col-m.col,2)) AS d2 FROM g JOIN m
      ON m.row BETWEEN g.row-12 AND g.row+12 AND m.col BETWEEN g.col-12 AND g.col+12 GROUP BY 1)
    SELECT g.cell, CASE WHEN d2<=144 THEN CAST(d2 AS BIGINT) END AS d2 FROM g LEFT JOIN p USING (cell)""",
)
def mask_distance(spark, d):
    c = grid(spark, d).withColumn("m", F.col("size") >= 48)
    return TI.mask_distance(c, K, "m", 12).select("cell", "d2")


@query(
    "mask_perimeter",
    f"""WITH {G}, m AS (SELECT row, col FROM g WHERE size>30), e AS (SELECT m.row+dr AS row, m.col+dc AS col FROM m CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0)) o(dr,dc))
    SELECT count(*) AS edges, count(*)*10.0::DOUBLE AS perimeter_m FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.row=e.row AND m.col=e.col)""",
)
def mask_perimeter(spark, d):
    return S.mask_perimeter(masked(spark, d), K, CELL).drop("raster")


_EAVN = 8


def _sites(spark, d):
    return pour_points(spark, d).withColumnRenamed("point", "site")


_POOL = f"""{G}, {_PP}, s0 AS (SELECT point AS site, g.cell, g.row, g.col, g.z FROM pp JOIN g USING (row,col)),
    lv AS (SELECT s0.site, s0.cell, s0.z AS z0, k, s0.z+k*0.5::DOUBLE AS lvl FROM s0 CROSS JOIN (SELECT unnest(range(1,{_EAVN + 1})) AS k)),
    pl AS (SELECT site, k, z0, lvl, cell FROM lv UNION SELECT p.site, p.k, p.z0, p.lvl, b.cell FROM pl p JOIN g a ON a.cell=p.cell JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1
      WHERE b.z>=p.z0 AND b.z<p.lvl)"""


@query(
    "elevation_area_volume",
    f"""WITH RECURSIVE {_POOL}, w AS (SELECT site, k, count(*) AS n, sum((lvl-g.z)*100) AS v FROM pl JOIN g USING (cell) GROUP BY 1,2)
    SELECT s0.site, k.k*0.5::DOUBLE AS level_m, round(s0.z+k.k*0.5,6) AS elevation_m, coalesce(n,0)*100.0::DOUBLE AS area_m2, round(coalesce(v,0),4) AS volume_m3
    FROM s0 CROSS JOIN (SELECT unnest(range(0,{_EAVN + 1})) AS k) k LEFT JOIN w ON w.site=s0.site AND w.k=k.k""",
)
def elevation_area_volume(spark, d):
    c = PL.pool_levels(_sites(spark, d), grid(spark, d), K, [0.5 * k for k in range(_EAVN + 1)], CELL**2).drop("raster", "z0")
    return rnd(c, 6).withColumn("volume_m3", F.round("volume_m3", 4))


@query(
    "impoundment",
    f"""WITH RECURSIVE {_POOL} SELECT site, round(sum((lvl-g.z)*100),4) AS volume_m3, count(*)*100.0::DOUBLE AS area_m2 FROM pl JOIN g USING (cell) WHERE k=4 GROUP BY 1""",
)
def impoundment(spark, d):
    pools = PL.pool_levels(_sites(spark, d), grid(spark, d), K, [2.0], CELL**2)
    return rnd(pools.select("site", "volume_m3", "area_m2"), 4)


@query(
    "suppress_neighbours",
    f"""WITH RECURSIVE {G}, c AS (SELECT row, col, cell AS id, z AS score, row_number() OVER (ORDER BY z DESC, cell) AS o FROM g),
    r AS (SELECT 1 AS rank, id, row, col, score, [{{'r':row,'c':col}}] AS ks FROM c WHERE o=1 UNION ALL
      SELECT rank+1, id, row, col, score, list_append(ks, {{'r':row,'c':col}}) FROM (
        SELECT r.rank, r.ks, c.id, c.row, c.col, c.score, row_number() OVER (ORDER BY c.o) AS b FROM r JOIN c
          ON len(list_filter(r.ks, lambda k: sqrt(pow(k.r-c.row,2)+pow(k.c-c.col,2))<12))=0 WHERE r.rank<6) WHERE b=1)
    SELECT rank, id, row, col, score FROM r""",
)
def suppress_neighbours(spark, d):
    s = grid(spark, d).select("raster", F.col("cell").alias("id"), "row", "col", F.col("z").alias("score"))
    return FL.suppress_near(s, K, 12.0, 6).drop("raster")


_RINGS = f"""{G}, {comp_sql("size>30")}, cl AS (SELECT label, row, col FROM cp JOIN g USING (cell)),
    sd(dir,nr,nc,sr,sc,er,ec) AS (VALUES (0,-1,0,0,0,0,1),(1,0,1,0,1,1,1),(2,1,0,1,1,1,0),(3,0,-1,1,0,0,0)),
    eg AS (SELECT label, dir, (c.row+sr)::BIGINT AS r, (c.col+sc)::BIGINT AS c, c.row+er AS er, c.col+ec AS ec, (((c.row+sr)::BIGINT*2147483648+(c.col+sc))*4+dir)::BIGINT AS edge FROM cl c CROSS JOIN sd
      WHERE NOT EXISTS (SELECT 1 FROM cl o WHERE o.label=c.label AND o.row=c.row+nr AND o.col=c.col+nc)),
    nx AS (SELECT a.label, a.edge, a.dir, a.r, a.c, arg_min(b.edge, CASE (b.dir-a.dir+4)%4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS next,
        arg_min(b.dir, CASE (b.dir-a.dir+4)%4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS turned
      FROM eg a JOIN eg b ON b.label=a.label AND b.r=a.er AND b.c=a.ec AND (b.dir-a.dir+4)%4<>2 GROUP BY ALL),
    wa AS (SELECT label, edge AS start, edge, next FROM nx UNION SELECT w.label, w.start, n.edge, n.next FROM wa w JOIN nx n ON n.label=w.label AND n.edge=w.next),
    ri AS (SELECT label, start AS edge, min(edge) AS ring FROM wa GROUP BY 1,2)"""


def label_rings(spark, d):
    """Rings around the groups of large parts."""
    from rillwork.operators import outline as OL

    lab = cut(TI.label_components(masked(spark, d), K))
    cells = lab.select("raster", "label", F.floor(F.col("cell") / WIDTH).cast("int").alias("row"), (F.col("cell") % WIDTH).cast("int").alias("col"))
    return cut(OL.outline_rings(cells, ["raster", "label"]))


@query(
    "outline_rings",
    f"""WITH RECURSIVE {_RINGS} SELECT label, ring, count(*) AS edges, count(*) FILTER (turned<>dir) AS corners, count(*)*10.0::DOUBLE AS length_m,
      sum(CASE dir WHEN 1 THEN c WHEN 3 THEN -c ELSE 0 END)*100.0::DOUBLE AS area_m2, sum(CASE dir WHEN 1 THEN c WHEN 3 THEN -c ELSE 0 END)<0 AS hole FROM nx JOIN ri USING (label, edge) GROUP BY 1,2""",
)
def outline_rings(spark, d):
    from rillwork.operators import outline as OL

    return OL.ring_facts(label_rings(spark, d), ["raster", "label"], CELL).drop("raster")


@query(
    "outline_features",
    f"""WITH RECURSIVE {_RINGS}, tu AS (SELECT a.label, a.next AS edge FROM nx a WHERE a.turned<>a.dir),
    sq AS (SELECT label, edge AS ring, edge, next, 0 AS pos FROM nx WHERE (label, edge) IN (SELECT label, ring FROM ri) UNION ALL SELECT s.label, s.ring, n.edge, n.next, s.pos+1 FROM sq s JOIN nx n ON n.label=s.label AND n.edge=s.next WHERE n.edge<>s.ring)
    SELECT sq.label, sq.ring, md5(string_agg(c||' '||r, ',' ORDER BY pos)) AS corners FROM sq JOIN tu USING (label, edge) JOIN nx USING (label, edge) GROUP BY 1,2""",
)
def outline_features(spark, d):
    """Hash of the corners of every ring as the features of the writer hold them, in order."""
    from rillwork.operators import outline as OL
    from rillwork.sources import sinks

    rings, keys = label_rings(spark, d), ["raster", "label"]
    made = sinks.ring_features(OL.ring_vertices(rings, keys), OL.ring_facts(rings, keys, CELL), keys, F.col("col"), F.col("row"))
    xy = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<long>>>")[0]
    told = F.transform(F.slice(xy, 1, F.size(xy) - 1), lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string")))
    return made.select("label", "ring", F.md5(F.concat_ws(",", told)).alias("corners"))
