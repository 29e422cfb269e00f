"""Land rules, masks, resampling, lines and polygons over ``part``, ``supplier`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog import terrain as CT
from rillwork.catalog.base import query, table
from rillwork.catalog.climate import rnd
from rillwork.catalog.terrain import CELL, G, K, comp_sql, grid
from rillwork.functions import geo
from rillwork.functions import terrain as T
from rillwork.operators import focal as FO
from rillwork.operators import land as L
from rillwork.operators import spatial as S
from rillwork.operators import tiles as TI
from rillwork.session import cut

CODES = (30, 40, 60, 90)


def context(spark, d, with_flow):
    """Slope, water, built-up and class of every cell, and its accumulation where a rule needs it."""
    c = CT.surfaces(grid(spark, d)).select("raster", "row", "col", "cell", "size", "slope")
    if with_flow:
        c = c.join(CT.accumulated(spark, d).select("raster", "cell", "acc"), ["raster", "cell"])
    code = (F.col("size") % 11) * 10
    return c.select(
        "raster", "row", "col", "cell", *(["acc"] if with_flow else []),
        (T.slope_pct(F.col("slope")) / 20).alias("slope_pct"),
        code.alias("code"),
        (F.col("size") == 50).alias("water"), (F.col("size") == 49).alias("built"),
        F.when(F.col("size") % 7 == 0, 3).when(F.col("size") % 7 == 1, 1).alias("own"),
    )


def rule():
    return (
        L.slope_under(15.0)
        & ~L.within_distance("d_water", 15.0, "water")
        & L.distance_band("d_built", "any_built", 10.0, 80.0)
        & L.class_in(CODES, "grassland/cropland/bare/wetland")
        & L.open_ownership()
    )


def _near(spark, d, with_flow=False):
    return L.near_masks(context(spark, d, with_flow), K, {"water": 15.0, "built": 80.0}, CELL)



_DIST = """dw AS (SELECT g.cell, min(sqrt(pow(g.row-m.row,2)+pow(g.col-m.col,2)))*10 AS dd FROM g JOIN g m ON m.size=50 AND m.row BETWEEN g.row-2 AND g.row+2 AND m.col BETWEEN g.col-2 AND g.col+2 GROUP BY 1),
    db AS (SELECT g.cell, min(sqrt(pow(g.row-m.row,2)+pow(g.col-m.col,2)))*10 AS dd FROM g JOIN g m ON m.size=49 AND m.row BETWEEN g.row-8 AND g.row+8 AND m.col BETWEEN g.col-8 AND g.col+8 GROUP BY 1),
    cx AS (SELECT g.row, g.col, g.cell, tan(radians(sf.slope))*100/20 AS slope_pct, (g.size%11)*10 AS code, dw.dd AS d_water, db.dd AS d_built,
      (SELECT count(*)>0 FROM g WHERE size=49) AS any_built, CASE g.size%7 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS own FROM g JOIN sf USING (cell) LEFT JOIN dw USING (cell) LEFT JOIN db USING (cell))"""
_R = ["slope_pct<=15", "NOT coalesce(d_water<=15,FALSE)", "(coalesce(d_built BETWEEN 10 AND 80,FALSE) OR NOT any_built)", "code IN (30,40,60,90)", "own IN (0,1,2)"]
_NAMES = ["slope < 15 %", "not (within 15 m of water)", "10-80 m from habitation", "land cover in grassland/cropland/bare/wetland", "government or community land (or ownership unknown)"]
ELIG = f"{CT.SURF}, {_DIST}, el AS (SELECT *, {' AND '.join(_R)} AS ok FROM cx)"


@query(
    "land_eligibility",
    f"WITH {ELIG} SELECT cell, ok AS eligible, array_to_string(list_filter([{','.join(f'CASE WHEN NOT ({r}) THEN {chr(39)}{n}{chr(39)} END' for r, n in zip(_R, _NAMES))}], lambda x: x IS NOT NULL),';') AS excluded_by FROM el",
)
def land_eligibility(spark, d):
    r = rule()
    return _near(spark, d).select(
        "cell", r.column.alias("eligible"), F.concat_ws(";", r.rejected_by()).alias("excluded_by")
    )


@query(
    "land_rule_counts",
    f"""WITH RECURSIVE {ELIG}, {CT.WALK.replace("nb AS", "nb2 AS").replace("FROM nb)", "FROM nb2)").replace("sl AS (SELECT *, ", "sl AS (SELECT *, ")},
    ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1)
    SELECT count(*) FILTER (ok AND acc>=3) AS both, count(*) FILTER (ok OR acc>=3) AS either, count(*) FILTER (NOT ok) AS neither FROM el JOIN ac USING (cell)""",
)
def land_rule_counts(spark, d):
    c, a, b = _near(spark, d, with_flow=True), rule(), L.min_upstream(300.0, CELL)
    return c.groupBy("raster").agg(
        F.count(F.when((a & b).column, 1)).alias("both"),
        F.count(F.when((a | b).column, 1)).alias("either"),
        F.count(F.when((~a).column, 1)).alias("neither"),
    ).drop("raster")


@query(
    "available_parcels",
    f"""WITH RECURSIVE {ELIG}, gg AS (SELECT row, col, cell FROM el WHERE ok), {comp_sql("TRUE").replace("FROM g WHERE", "FROM gg WHERE")},
    sz AS (SELECT label, count(*) AS n FROM cp GROUP BY 1 HAVING count(*)>=3), j AS (SELECT cp.label, el.code, el.slope_pct FROM cp JOIN sz USING (label) JOIN el USING (cell)),
    bc AS (SELECT label, code, count(*) AS n FROM j GROUP BY 1,2), dm AS (SELECT label, max_by(code,{{'n':n,'c':-code}}) AS code FROM bc GROUP BY 1)
    SELECT label, count(*) AS cells, round(avg(slope_pct),6) AS mean_slope_pct, any_value(dm.code) AS code, row_number() OVER (ORDER BY label) AS number, round(count(*)*0.01,6)::DOUBLE AS area_ha
    FROM j JOIN dm USING (label) GROUP BY label""",
)
def available_parcels(spark, d):
    from rillwork.plans.land import available_land

    _, parcels = available_land(_near(spark, d), K, rule(), 300.0, CELL)
    return rnd(parcels.drop("raster"), 6)


@query(
    "suitability_surface",
    f"""WITH RECURSIVE {ELIG}, {CT.WALK.replace("nb AS", "nb2 AS").replace("FROM nb)", "FROM nb2)")},
    ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1), tw AS (SELECT sf.cell, ln(greatest(acc*10.0::DOUBLE,10)/greatest(hyp,0.001)) AS twi, acc FROM sf JOIN ac USING (cell)),
    sp AS (SELECT min(twi) AS lo, max(twi) AS hi FROM tw),
    pt AS (SELECT el.*, log10(greatest(acc*100.0::DOUBLE/10000,0.001)) AS la, (twi-lo)/greatest(hi-lo,1e-9) AS wet FROM el JOIN tw USING (cell) CROSS JOIN sp)
    SELECT cell, CASE WHEN ok THEN round((0.35*greatest(least((la-0)/1,(3-la)/(3-log10(150)),1),0)+0.2*greatest(least((15-slope_pct)/12,1),0)+0.15*wet)/0.7,6) ELSE 0 END AS score FROM pt""",
)
def suitability_surface(spark, d):
    from rillwork.operators.flow import AREA_HA, normalise
    import math

    s = CT.surfaces(grid(spark, d)).select("raster", "cell", "dx", "dy")
    c = _near(spark, d, with_flow=True).join(s, ["raster", "cell"])
    c = c.withColumn("twi", T.wetness(F.col("dx"), F.col("dy"), F.col("acc"), F.lit(CELL)))
    c = normalise(c, K, {"wet": "twi"})
    la = F.log10(F.greatest(F.col("acc").cast("double") * CELL**2 / 1e4, F.lit(1e-3)))
    parts = {
        "upstream_area": T.through(la, T.hill([math.log10(b) for b in AREA_HA])),
        "flatness": T.plateau(F.col("slope_pct")),
        "wetness": F.col("wet"),
    }
    w = {"upstream_area": 0.35, "flatness": 0.20, "wetness": 0.15}
    score = F.when(rule().column, F.round(T.weighted_score(w, parts, renormalise=True), 6)).otherwise(0.0)
    return c.select("cell", score.alias("score"))


_BAND = """bd AS (SELECT row, col, cell, size*20.0 AS green, (50-size)*20.0 AS nir FROM g), nd AS (SELECT *, CASE WHEN green+nir>0 THEN (green-nir)/(green+nir) END AS ix FROM bd)"""


def index(spark, d):
    g = grid(spark, d)
    return g.select(
        "raster", "row", "col", "cell", T.ndwi(F.col("size") * 20.0, (50 - F.col("size")) * 20.0).alias("ix")
    )


_OTSU = f"""{_BAND}, by_ AS (SELECT *, CAST(trunc(least(greatest((ix::DOUBLE+1)*127.5,0),255)) AS INTEGER) AS b FROM nd WHERE ix IS NOT NULL),
    h AS (SELECT b, count(*) AS n FROM by_ GROUP BY 1), cu AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n*b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS nn, sum(n*b) OVER () AS ss FROM h),
    ot AS (SELECT max_by(b, {{'v': CASE WHEN nn-w0>0 THEN round(w0::DOUBLE*(nn-w0)*pow(s0::DOUBLE/w0-(ss-s0)::DOUBLE/(nn-w0),2),6) ELSE 0 END, 'b': -b}}) AS threshold FROM cu)"""


@query("otsu_threshold", f"WITH {G}, {_OTSU} SELECT threshold, round(greatest(threshold/127.5::DOUBLE-1,0),6) AS ndwi_threshold FROM ot")
def otsu_threshold(spark, d):
    px = index(spark, d).filter(F.col("ix").isNotNull()).withColumn("b", T.byte_scale(F.col("ix")))
    t = L.otsu(px, K, "b")
    return t.select("threshold", F.round(F.greatest(F.col("threshold") / 127.5 - 1, F.lit(0.0)), 6).alias("ndwi_threshold"))


@query(
    "water_mask",
    f"""WITH RECURSIVE {G}, {_OTSU}, bi AS (SELECT row, col, cell, CASE WHEN (SELECT threshold FROM ot)/127.5-1<0 THEN CAST(ix>0 AS INTEGER) ELSE CAST(b>(SELECT threshold FROM ot) AS INTEGER) END AS m FROM by_),
    {CT._morph_sql("bi", "-++-")}, gg AS (SELECT * FROM mo3), {comp_sql("m=1").replace("FROM g WHERE", "FROM gg WHERE")}, sz AS (SELECT label FROM cp GROUP BY 1 HAVING count(*)>=2)
    SELECT cell, label FROM cp JOIN sz USING (label)""",
)
def water_mask(spark, d):
    from rillwork.plans.land import water_mask as job

    mask, _ = job(index(spark, d), K, CELL, 200.0)
    return mask.select("cell", "label")


@query(
    "water_summary",
    f"""WITH RECURSIVE {G}, {_OTSU}, bi AS (SELECT row, col, cell, CASE WHEN (SELECT threshold FROM ot)/127.5-1<0 THEN CAST(ix>0 AS INTEGER) ELSE CAST(b>(SELECT threshold FROM ot) AS INTEGER) END AS m FROM by_),
    {CT._morph_sql("bi", "-++-")}, gg AS (SELECT * FROM mo3), {comp_sql("m=1").replace("FROM g WHERE", "FROM gg WHERE")}, {comp_sql("m=1", "cb").replace("FROM g WHERE", "FROM bi WHERE")},
    sz AS (SELECT label, count(*) AS n FROM cp GROUP BY 1 HAVING count(*)>=2)
    SELECT (SELECT count(DISTINCT label) FROM cb) AS components_before, (SELECT count(*) FROM sz) AS components_after,
      round((SELECT coalesce(sum(n),0) FROM sz)::DOUBLE/(SELECT count(*) FROM by_),6) AS water_fraction""",
)
def water_summary(spark, d):
    from rillwork.plans.land import water_mask as job

    _, facts = job(index(spark, d), K, CELL, 200.0)
    return facts.select("components_before", "components_after", F.round("water_fraction", 6).alias("water_fraction"))


_SC = ",".join(f"({i})" for i in range(5))


@query(
    "season_composite",
    f"""WITH {G}, b AS (SELECT row, col, i, size*20.0::DOUBLE+i*3 AS green, (50-size)*20.0::DOUBLE+i AS nir, (size+i)%12 AS scl FROM g CROSS JOIN (VALUES {_SC}) v(i) WHERE i*6<=20 AND i IN (1,2,3)),
    ok AS (SELECT *, scl NOT IN (0,1,3,8,9,10,11) AND green>0 AND nir>0 AS ok FROM b)
    SELECT row, col, median(green) FILTER (ok) AS green, median(nir) FILTER (ok) AS nir FROM ok GROUP BY 1,2""",
)
def season_composite(spark, d):
    """Five scenes of the grid; the cloudiest is unusable and the next one not among the clearest."""
    i = F.col("i")
    g = grid(spark, d).withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(5)])))
    bands = g.select(
        "raster", "row", "col", i.alias("scene"), (F.col("size") * 20.0 + i * 3).alias("green"), ((50 - F.col("size")) * 20.0 + i).alias("nir"),
        ((F.col("size") + i) % 12).alias("scl"), F.when(i == 0, 19.0).otherwise(i * 6.0).alias("cloud"),
    )
    return L.season_composite(bands, K).drop("raster")


@query(
    "seasonal_water",
    f"""WITH {G} SELECT cell, CASE WHEN size>40 THEN 'perennial' ELSE 'seasonal' END AS season FROM g WHERE size>30""",
)
def seasonal_water(spark, d):
    from rillwork.plans.land import combine_seasons

    g = grid(spark, d).select("raster", "row", "col", "cell", "size")
    return combine_seasons(g.filter("size > 40"), g.filter("size > 30"), K).select("cell", "season")


def _season_sql(wetter: int) -> str:
    """Water cells of one season's scenes."""
    band = f"""sb AS (SELECT row, col, cell, (size+{wetter})*20.0::DOUBLE+i*3 AS green, (50-size)*20.0::DOUBLE+i AS nir, (size+i)%12 NOT IN (0,1,3,8,9,10,11) AS ok FROM g CROSS JOIN (VALUES (1),(2),(3)) v(i)),
      bd AS (SELECT row, col, cell, median(green) FILTER (ok AND green>0 AND nir>0) AS green, median(nir) FILTER (ok AND green>0 AND nir>0) AS nir FROM sb GROUP BY 1,2,3), nd AS (SELECT *, CASE WHEN green+nir>0 THEN (green-nir)/(green+nir) END AS ix FROM bd)"""
    return f"""(WITH RECURSIVE {G}, {_OTSU.replace(_BAND, band)}, bi AS (SELECT row, col, cell, CASE WHEN (SELECT threshold FROM ot)/127.5-1<0 THEN CAST(ix>0 AS INTEGER) ELSE CAST(b>(SELECT threshold FROM ot) AS INTEGER) END AS m FROM by_),
      {CT._morph_sql("bi", "-++-")}, gg AS (SELECT * FROM mo3), {comp_sql("m=1").replace("FROM g WHERE", "FROM gg WHERE")}, sz AS (SELECT label FROM cp GROUP BY 1 HAVING count(*)>=2) SELECT cell FROM cp JOIN sz USING (label))"""


@query(
    "seasonal_water_of_scenes",
    f"SELECT w.cell, CASE WHEN d.cell IS NULL THEN 'seasonal' ELSE 'perennial' END AS season FROM {_season_sql(8)} w LEFT JOIN {_season_sql(0)} d ON d.cell=w.cell",
)
def seasonal_water_of_scenes(spark, d):
    """Perennial and seasonal water from the scenes of a dry and a wet season."""
    from rillwork.plans.land import seasonal_water as job

    i = F.col("i")

    def bands(wetter):
        g = grid(spark, d).withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(5)])))
        return g.select(
            "raster", "row", "col", i.alias("scene"), ((F.col("size") + wetter) * 20.0 + i * 3).alias("green"), ((50 - F.col("size")) * 20.0 + i).alias("nir"),
            ((F.col("size") + i) % 12).alias("scl"), F.when(i == 0, 19.0).otherwise(i * 6.0).alias("cloud"),
        )

    water, _ = job(bands(0), bands(8), K, CT.cols(), CELL, 200.0)
    return water.select("cell", "season")


@query(
    "mask_agreement",
    f"""WITH {G} SELECT count(*) FILTER (size>30 AND z>950)::DOUBLE/count(*) FILTER (size>30 OR z>950) AS jaccard,
    count(*) FILTER (size>30)-count(*) FILTER (z>950) AS size_delta FROM g""",
)
def mask_agreement(spark, d):
    from rillwork.plans.land import mask_overlap

    g = grid(spark, d)
    return mask_overlap(g.filter("size > 30"), g.filter("z > 950"), K).drop("raster")


@query(
    "surface_agreement",
    f"""WITH {G}, j AS (SELECT a.z, a.z+b.size/10.0-2 AS y FROM g a JOIN g b ON b.row=a.row AND b.col=39-a.col WHERE a.size<>7)
    SELECT count(*) AS n, round(avg(y-z),6) AS bias, round(sqrt(avg(pow(y-z,2))),6) AS rmse, round(stddev_pop(y-z),6) AS rmse_unbiased, round(corr(z,y),6) AS r FROM j""",
)
def surface_agreement(spark, d):
    from rillwork.plans.land import surface_agreement as job

    a = grid(spark, d).withColumn("z", F.when(F.col("size") != 7, F.col("z")))
    flip = grid(spark, d).select("raster", "row", (39 - F.col("col")).alias("col"), (F.col("size") / 10.0 - 2).alias("s"))
    b = grid(spark, d).join(flip, ["raster", "row", "col"]).withColumn("z", F.col("z") + F.col("s"))
    return rnd(job(a, b, K).drop("raster"), 6)


@query(
    "channel_agreement",
    f"""WITH {G}, a AS (SELECT * FROM g WHERE size>40), b AS (SELECT * FROM g WHERE size<6)
    SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE abs(b.row-a.row)<=2 AND abs(b.col-a.col)<=2) THEN 1.0::DOUBLE ELSE 0 END),6) AS share FROM a""",
)
def channel_agreement(spark, d):
    from rillwork.plans.land import channel_agreement as job

    g = grid(spark, d).select("raster", "row", "col", "size")
    return rnd(job(g.filter("size > 40"), g.filter("size < 6"), K, 2).drop("raster"), 6)


@query(
    "resample_nearest",
    f"""WITH {G}, t AS (SELECT s_suppkey AS id, s_acctbal/250-1 AS sx, s_nationkey*1.7::DOUBLE+s_suppkey*0.13::DOUBLE AS sy FROM supplier)
    SELECT t.id, coalesce(size,0) AS size FROM t LEFT JOIN g ON g.row=floor(t.sy) AND g.col=floor(t.sx)""",
)
def resample_nearest(spark, d):
    t = targets(spark, d)
    return S.resample_nearest(t, grid(spark, d), K, "size", 0).select("id", "size")


def targets(spark, d):
    return table(spark, d, "supplier").select(
        F.lit("g").alias("raster"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 250 - 1).alias("sx"),
        (F.col("s_nationkey") * F.lit(1.7) + F.col("s_suppkey") * F.lit(0.13)).alias("sy"),
    )


@query(
    "resample_bilinear",
    f"""WITH {G}, t AS (SELECT s_suppkey AS id, s_acctbal/250-1-0.5 AS gx, s_nationkey*1.7::DOUBLE+s_suppkey*0.13::DOUBLE-0.5 AS gy FROM supplier),
    c AS (SELECT id, floor(gy)+b AS row, floor(gx)+a AS col, (CASE a WHEN 1 THEN gx-floor(gx) ELSE 1-(gx-floor(gx)) END)*(CASE b WHEN 1 THEN gy-floor(gy) ELSE 1-(gy-floor(gy)) END) AS w FROM t CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) o(a,b))
    SELECT id, round(sum(w*z)/sum(w),6) AS z FROM c JOIN g USING (row,col) WHERE w>0 GROUP BY 1""",
)
def resample_bilinear(spark, d):
    return rnd(S.resample_bilinear(targets(spark, d), grid(spark, d), K, "id", "z").drop("raster"), 6)


@query(
    "tile_mosaic",
    f"""WITH {G}, t AS (SELECT row, col, 1 AS k, CASE WHEN size>25 THEN z END AS z FROM g UNION ALL SELECT row, col, 2, CASE WHEN size>10 THEN z+1 END FROM g UNION ALL SELECT row, col, 3, z+2 FROM g)
    SELECT row, col, min_by(z,k) AS z FROM t WHERE z IS NOT NULL GROUP BY 1,2""",
)
def tile_mosaic(spark, d):
    g = grid(spark, d).select("raster", "row", "col", "z", "size")
    t = [
        g.select("raster", "row", "col", F.lit(1).alias("k"), F.when(F.col("size") > 25, F.col("z")).alias("z")),
        g.select("raster", "row", "col", F.lit(2).alias("k"), F.when(F.col("size") > 10, F.col("z") + 1).alias("z")),
        g.select("raster", "row", "col", F.lit(3).alias("k"), (F.col("z") + 2).alias("z")),
    ]
    return S.mosaic(t[0].unionByName(t[1]).unionByName(t[2]), K, "z", "k").drop("raster")


def boxes(spark, d):
    """A lon/lat box per supplier."""
    s = table(spark, d, "supplier")
    west, south = F.col("s_nationkey") * 3.0 - 40.25, F.col("s_acctbal") / 400 - 10.5
    return s.select(
        F.col("s_suppkey").alias("id"), west.alias("west"), south.alias("south"),
        (west + 0.5 + (F.col("s_suppkey") % 3)).alias("east"), (south + 0.25 + (F.col("s_suppkey") % 2)).alias("north"),
    )


_BOX = "bx AS (SELECT s_suppkey AS id, s_nationkey*3.0::DOUBLE-40.25 AS west, s_acctbal/400-10.5 AS south, s_nationkey*3.0::DOUBLE-40.25+0.5+s_suppkey%3 AS east, s_acctbal/400-10.5+0.25+s_suppkey%2 AS north FROM supplier)"


def _tiles_sql(step: int) -> str:
    return f"""WITH {_BOX}, t AS (SELECT id, unnest(range(CAST(floor(south/{step})*{step} AS BIGINT), CAST(floor(north/{step})*{step} AS BIGINT)+1, {step})) AS lat, west, east FROM bx),
    u AS (SELECT id, lat, unnest(range(CAST(floor(west/{step})*{step} AS BIGINT), CAST(floor(east/{step})*{step} AS BIGINT)+1, {step})) AS lon FROM t)
    SELECT id, CAST(lat AS INTEGER) AS lat, CAST(lon AS INTEGER) AS lon, (CASE WHEN lat<0 THEN 'S' ELSE 'N' END)||lpad(abs(lat)::VARCHAR,2,'0')||(CASE WHEN lon<0 THEN 'W' ELSE 'E' END)||lpad(abs(lon)::VARCHAR,3,'0') AS tile FROM u"""


@query("degree_tiles", _tiles_sql(1))
def degree_tiles(spark, d):
    return S.tile_keys(boxes(spark, d), 1, "id")


@query("three_degree_tiles", _tiles_sql(3))
def three_degree_tiles(spark, d):
    return S.tile_keys(boxes(spark, d), 3, "id")


def _utm_sql(lon: str, lat: str, epsg: str) -> tuple[str, str]:
    lam = f"(radians({lon})-radians(({epsg}%100)*6.0-183.0))"
    e = geo._E
    t = f"sinh(atanh(sin(radians({lat})))-{e!r}::DOUBLE*atanh({e!r}::DOUBLE*sin(radians({lat}))))"
    xi, eta = f"atan2({t},cos({lam}))", f"atanh(sin({lam})/sqrt(1+{t}*{t}))"
    return xi, eta


def _series(xi: str, eta: str) -> tuple[str, str]:
    x, y = eta, xi
    for j, a in enumerate(geo._ALPHA, 1):
        x += f"+{a!r}::DOUBLE*cos({2 * j}*{xi})*sinh({2 * j}*{eta})"
        y += f"+{a!r}::DOUBLE*sin({2 * j}*{xi})*cosh({2 * j}*{eta})"
    k = geo._K0 * geo._RECT
    return f"{k!r}::DOUBLE*({x})+500000", f"{k!r}::DOUBLE*({y})"


_XI, _ETA = _utm_sql("west", "south", "epsg")
_UX, _UY = _series("xi", "eta")


@query(
    "utm_coordinates",
    f"""WITH {_BOX}, z AS (SELECT *, CAST(floor((west+180)/6)%60+1 AS INTEGER)+CASE WHEN south>=0 THEN 32600 ELSE 32700 END AS epsg FROM bx),
    q AS (SELECT *, {_XI} AS xi, {_ETA} AS eta FROM z)
    SELECT id, epsg, round({_UX},3) AS x, round({_UY}+CASE WHEN epsg>=32700 THEN 10000000 ELSE 0 END,3) AS y, round(west,6) AS lon_back, round(south,6) AS lat_back FROM q""",
)
def utm_coordinates(spark, d):
    b = boxes(spark, d).withColumn("epsg", geo.utm_epsg(F.col("west"), F.col("south")))
    b = b.withColumn("p", geo.to_utm(F.col("west"), F.col("south"), F.col("epsg")))
    b = b.withColumn("q", geo.from_utm(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    return b.select(
        "id", "epsg", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"),
        F.round("q.lon", 6).alias("lon_back"), F.round("q.lat", 6).alias("lat_back"),
    )


def _corner(n: str, lon: str, lat: str) -> str:
    a, b = _utm_sql(lon, lat, "epsg")
    return f"{a} AS xi{n}, {b} AS eta{n}"


def _cxy(n: str) -> str:
    x, y = _series(f"xi{n}", f"eta{n}")
    return f"{x} AS x{n}, {y}+CASE WHEN epsg>=32700 THEN 10000000 ELSE 0 END AS y{n}"


BOX_FACTS_SQL = f"""WITH {_BOX}, z AS (SELECT *, CAST(floor(((west+east)/2+180)/6)%60+1 AS INTEGER)+CASE WHEN (south+north)/2>=0 THEN 32600 ELSE 32700 END AS epsg FROM bx),
    a AS (SELECT id, epsg, {_corner("1", "west", "south")}, {_corner("2", "east", "south")}, {_corner("3", "east", "north")}, {_corner("4", "west", "north")} FROM z),
    c AS (SELECT id, epsg, {", ".join(_cxy(n) for n in "1234")} FROM a),
    f AS (SELECT id, epsg, CAST(ceil((greatest(y1,y2,y3,y4)-least(y1,y2,y3,y4))/100) AS BIGINT) AS rows, CAST(ceil((greatest(x1,x2,x3,x4)-least(x1,x2,x3,x4))/100) AS BIGINT) AS cols,
      abs(x1*y2-x2*y1+x2*y3-x3*y2+x3*y4-x4*y3+x4*y1-x1*y4)/2/1e6 AS area_km2 FROM c)
    SELECT * FROM f"""


@query(
    "box_grid_and_area",
    f"SELECT id, epsg, rows, cols, round(area_km2,3) AS area_km2 FROM ({BOX_FACTS_SQL}) WHERE area_km2 BETWEEN 2000 AND 30000",
)
def box_grid_and_area(spark, d):
    c = (F.col(x) for x in ("west", "south", "east", "north"))
    f = boxes(spark, d).select("id", geo.box_facts(*c, 100.0).alias("f")).select("id", "f.*")
    return S.within_area(f, 2000, 30000).select("id", "epsg", "rows", "cols", F.round("area_km2", 3).alias("area_km2"))


def polygons(spark, d):
    """A quadrilateral per supplier in grid units, as edges."""
    s = CT.pour_points(spark, d).select("point", F.col("row").cast("double").alias("r"), F.col("col").cast("double").alias("c"))
    pts = [(0.2, 0.1), (5.6, 1.3), (4.3, 6.7), (-1.4, 4.2)]
    edges = []
    for i, (x, y) in enumerate(pts):
        u, v = pts[(i + 1) % 4]
        edges.append(
            F.struct(
                (F.col("c") + x).alias("x0"), (F.col("r") + y).alias("y0"), (F.col("c") + u).alias("x1"), (F.col("r") + v).alias("y1")
            )
        )
    return s.select("point", F.inline(F.array(*edges)))


_QUAD = [(0.2, 0.1), (5.6, 1.3), (4.3, 6.7), (-1.4, 4.2)]
_QE = " UNION ALL ".join(
    f"SELECT point, col+({x}::DOUBLE) AS x0, row+({y}::DOUBLE) AS y0, col+({_QUAD[(i + 1) % 4][0]}::DOUBLE) AS x1, row+({_QUAD[(i + 1) % 4][1]}::DOUBLE) AS y1 FROM pp"
    for i, (x, y) in enumerate(_QUAD)
)


@query(
    "polygon_cells",
    f"""WITH {G}, {CT._PP}, e AS ({_QE}), bb AS (SELECT point, min(x0) AS a, max(x0) AS b, min(y0) AS c, max(y0) AS d FROM e GROUP BY 1),
    cand AS (SELECT point, g.cell, g.row, g.col FROM bb JOIN g ON g.col BETWEEN floor(a) AND floor(b) AND g.row BETWEEN floor(c) AND floor(d)),
    ins AS (SELECT k.point, k.cell FROM cand k JOIN e USING (point) WHERE (y0<k.row+0.5)<>(y1<k.row+0.5) AND x0+(k.row+0.5-y0)/(y1-y0)*(x1-x0)>k.col+0.5 GROUP BY 1,2 HAVING count(*)%2=1),
    tch AS (SELECT DISTINCT k.point, k.cell FROM cand k JOIN e USING (point) WHERE greatest(least(y0,y1),k.row)<=least(greatest(y0,y1),k.row+1)
      AND floor(least(x0+(greatest(least(y0,y1),k.row)-y0)/(y1-y0)*(x1-x0), x0+(least(greatest(y0,y1),k.row+1.0)-y0)/(y1-y0)*(x1-x0)))<=k.col
      AND floor(greatest(x0+(greatest(least(y0,y1),k.row)-y0)/(y1-y0)*(x1-x0), x0+(least(greatest(y0,y1),k.row+1.0)-y0)/(y1-y0)*(x1-x0)))>=k.col)
    SELECT * FROM ins UNION SELECT * FROM tch""",
)
def polygon_cells(spark, d):
    return S.polygon_cells(grid(spark, d), polygons(spark, d), "point").select("point", "cell")


@query(
    "nearest_gap_fill",
    f"""WITH {G}, h AS (SELECT * FROM g WHERE size<25), v AS (SELECT * FROM g WHERE size>=25),
    r AS (SELECT h.cell, v.z, row_number() OVER (PARTITION BY h.cell ORDER BY sqrt(pow(h.row-v.row,2)+pow(h.col-v.col,2)), v.row, v.col) AS k FROM h JOIN v ON v.row BETWEEN h.row-9 AND h.row+9 AND v.col BETWEEN h.col-9 AND h.col+9)
    SELECT cell, z FROM r WHERE k=1 UNION ALL SELECT cell, z FROM v""",
)
def nearest_gap_fill(spark, d):
    g = grid(spark, d).withColumn("z", F.when(F.col("size") >= 25, F.col("z")))
    return S.fill_gaps(g, K, "z", 1.5).select("cell", "z")


@query(
    "scattered_interpolation",
    f"""WITH {G}, v AS (SELECT * FROM g WHERE size>=40), t AS (SELECT s_suppkey AS id, s_acctbal/250-1 AS x, s_nationkey*1.7::DOUBLE AS y FROM supplier),
    r AS (SELECT t.id, v.z, sqrt(pow(v.col-t.x,2)+pow(v.row-t.y,2)) AS d, row_number() OVER (PARTITION BY t.id ORDER BY sqrt(pow(v.col-t.x,2)+pow(v.row-t.y,2)), v.cell) AS k FROM t CROSS JOIN v)
    SELECT id, round(coalesce(max(z) FILTER (d=0), sum(z/(d*d))/sum(1/(d*d))),6) AS z FROM r WHERE k<=6 GROUP BY 1""",
)
def scattered_interpolation(spark, d):
    t = table(spark, d, "supplier").select(
        F.lit("g").alias("raster"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 250 - 1).alias("x"),
        (F.col("s_nationkey") * F.lit(1.7)).alias("y"),
    )
    v = grid(spark, d).filter("size >= 40").select("raster", F.col("col").alias("x"), F.col("row").alias("y"), "z", "cell")
    near = S.nearest_k(t, v, ("x", "y"), K, "id", 6, 4.0, ["cell"])
    return rnd(S.inverse_distance(near, K, "id", "z").drop("raster"), 6)


def contours(spark, d):
    """One line per order: elevation from the priority, vertices from its items."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q")
    )
    v = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("p") / 1000).alias("x"), F.col("q").alias("y")))).alias("v")
    )
    return v.select(
        (F.col("l_orderkey") % 5).alias("map_id"), F.col("l_orderkey").alias("line_id"),
        (F.size("v") * 2.5).alias("elevation"), F.when(F.size("v") % 2 == 0, "z").otherwise("name").alias("source"),
        F.transform("v", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"))).alias("vertices"),
    )


_CV = """li AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice)/1000 AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1,2),
    ln AS (SELECT l_orderkey%5 AS map_id, l_orderkey AS line_id, count(*) AS nv, count(*)*2.5::DOUBLE AS elevation FROM li GROUP BY 1,2),
    sg AS (SELECT l_orderkey AS line_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w AS i FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))"""


@query(
    "contour_facts",
    f"""WITH {_CV}, lv AS (SELECT DISTINCT map_id, elevation FROM ln), gp AS (SELECT map_id, elevation-lag(elevation) OVER (PARTITION BY map_id ORDER BY elevation) AS gap FROM lv),
    p AS (SELECT map_id, count(*) AS levels, median(gap) AS interval FROM gp GROUP BY 1)
    SELECT ln.map_id, count(*) AS lines, CAST(sum(nv) AS BIGINT) AS vertices, min(elevation) AS z_min, max(elevation) AS z_max, any_value(levels) AS levels, any_value(p.interval) AS interval,
      any_value(x_min) AS x_min, any_value(x_max) AS x_max, any_value(y_min) AS y_min, any_value(y_max) AS y_max FROM ln JOIN p USING (map_id)
      JOIN (SELECT l_orderkey%5 AS map_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM li GROUP BY 1) b USING (map_id) GROUP BY 1""",
)
def contour_facts(spark, d):
    return S.contour_facts(contours(spark, d))


@query(
    "contour_sources",
    f"WITH {_CV} SELECT map_id, CASE WHEN nv%2=0 THEN 'z' ELSE 'name' END AS source, count(*) AS lines FROM ln GROUP BY 1,2",
)
def contour_sources(spark, d):
    return S.source_counts(contours(spark, d))


@query(
    "polyline_lengths",
    f"WITH {_CV} SELECT line_id, round(coalesce(sum(sqrt(pow(x-px,2)+pow(y-py,2))),0),4) AS length FROM sg GROUP BY 1",
)
def polyline_lengths(spark, d):
    return contours(spark, d).select("line_id", F.round(S.polyline_length(F.col("vertices")), 4).alias("length"))


@query(
    "densified_lines",
    f"""WITH {_CV}, s AS (SELECT *, sqrt(pow(x-px,2)+pow(y-py,2)) AS len FROM sg), c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY i),0) AS too FROM s),
    t AS (SELECT line_id, max(too) AS total, count(*) AS nv FROM c GROUP BY 1), k AS (SELECT line_id, total, CAST(ceil(total/20)+1 AS BIGINT) AS n FROM t WHERE total>20)
    SELECT line_id, n AS points FROM k UNION ALL SELECT line_id, nv FROM t WHERE total<=20""",
)
def densified_lines(spark, d):
    dense = S.densify(contours(spark, d), "line_id", "vertices", 20.0)
    return dense.groupBy("line_id").agg(F.count(F.lit(1)).alias("points"))


@query(
    "deduped_vertices",
    """WITH v AS (SELECT l_orderkey%5 AS map_id, round(l_quantity/3,1) AS x, round(l_extendedprice/2000,1) AS y, l_orderkey*10+l_linenumber AS ord FROM lineitem)
    SELECT map_id, x, y, min(ord) AS ord FROM v GROUP BY 1,2,3""",
)
def deduped_vertices(spark, d):
    v = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("map_id"), F.round(F.col("l_quantity") / 3, 1).alias("x"),
        F.round(F.col("l_extendedprice") / 2000, 1).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return S.dedupe_vertices(v, ["map_id"], ["ord"], 1)


_HULL = """e AS (SELECT map_id, y, min(x) AS x FROM p GROUP BY 1,2 UNION SELECT map_id, y, max(x) FROM p GROUP BY 1,2),
    sides AS (SELECT a.map_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM e a JOIN e b ON a.map_id=b.map_id AND (a.x<>b.x OR a.y<>b.y)
      WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.map_id=a.map_id AND ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)<0
        OR ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)=0 AND (c.x-a.x)*(c.x-b.x)+(c.y-a.y)*(c.y-b.y)>0)))),
    hu AS (SELECT map_id, abs(sum(x0*y1-x1*y0))/2 AS hull_area FROM sides GROUP BY 1)"""


@query(
    "convex_hull_area",
    f"""WITH p AS (SELECT l_suppkey%7 AS map_id, l_extendedprice AS x, l_quantity::DOUBLE AS y FROM lineitem), {_HULL} SELECT map_id, round(hull_area,3) AS hull_area FROM hu""",
)
def convex_hull_area(spark, d):
    p = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("map_id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y")
    )
    return S.hull_area(p, ["map_id"], pieces=16).withColumn("hull_area", F.round("hull_area", 3))


@query(
    "contour_spacing",
    f"""WITH {_CV}, p AS (SELECT l_orderkey%5 AS map_id, x, y::DOUBLE AS y FROM li), {_HULL}, t AS (SELECT line_id%5 AS map_id, sum(sqrt(pow(x-px,2)+pow(y-py,2))) AS length FROM sg GROUP BY 1)
    SELECT map_id, round(length,3) AS length, round(hull_area,3) AS hull_area, round(hull_area/length,8) AS spacing FROM t JOIN hu USING (map_id)""",
)
def contour_spacing(spark, d):
    s = S.contour_spacing(contours(spark, d), pieces=16)
    return s.select("map_id", F.round("length", 3).alias("length"), F.round("hull_area", 3).alias("hull_area"), F.round("spacing", 8).alias("spacing"))


@query(
    "equal_boundaries",
    """WITH b AS (SELECT p_size*1.0 AS x, length(p_type)*1.0 AS y, p_partkey%5=4 AS bow FROM part) SELECT count(*) AS polygons, count(DISTINCT (x,y,bow)) AS distinct_boundaries FROM b""",
)
def equal_boundaries(spark, d):
    p = table(spark, d, "part")
    x, y = F.col("p_size") + F.lit(0.0), F.length("p_type") + F.lit(0.0)
    turn = F.col("p_partkey") % 5  # the same square from other vertices, closed, the other way; and a bow-tie on its corners
    a, b, c, e = (F.struct((x + i).alias("x"), (y + j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))
    rings = ((a, b, c, e), (b, c, e, a), (c, e, a, b, c), (c, b, a, e))
    ring = F.array(a, c, b, e)
    for i, r in enumerate(rings):
        ring = F.when(turn == i, F.array(*r)).otherwise(ring)
    keyed = p.select(S.boundary_key(ring).alias("k"))
    per = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("polygons"), F.count(F.lit(1)).alias("distinct_boundaries"))


SOURCES = (("alpha", "the|and", 12.5), ("beta", "tion", 30.0), ("gamma", "ou", 30.0), ("delta", "src", 90.0))


@query(
    "text_provenance",
    """WITH s AS (SELECT doc_id, len(regexp_extract_all(lower(text),'the|and')) AS a, len(regexp_extract_all(lower(text),'tion')) AS b, len(regexp_extract_all(lower(text),'ou')) AS c,
      len(regexp_extract_all(lower(text),'src')) AS e FROM documents), m AS (SELECT *, greatest(a,b,c,e) AS m FROM s)
    SELECT doc_id, CASE WHEN m=0 THEN 'assumed' WHEN a=m THEN 'alpha' WHEN c=m THEN 'gamma' WHEN b=m THEN 'beta' ELSE 'delta' END AS dataset,
      CASE WHEN m=0 THEN NULL WHEN a=m THEN 12.5 WHEN c=m OR b=m THEN 30.0 ELSE 90.0 END::DOUBLE AS resolution, m AS score FROM m""",
)
def text_provenance(spark, d):
    return S.score_text(table(spark, d, "documents"), "doc_id", "text", SOURCES)


_AHP = "[1.0::DOUBLE,1+abs(b)/2000,3.0,1+abs(b)/5000]"


@query(
    "criterion_weights",
    f"""WITH s AS (SELECT s_nationkey AS judge, avg(s_acctbal) AS b FROM supplier GROUP BY 1), w AS (SELECT judge, {_AHP} AS w FROM s)
    SELECT judge, i AS criterion, round(w[i+1]/list_sum(w),6) AS weight, 4.0::DOUBLE AS lambda_max, 0.0::DOUBLE AS ci, 0.0::DOUBLE AS cr
    FROM w CROSS JOIN (SELECT CAST(unnest(range(0,4)) AS INTEGER) AS i)""",
)
def criterion_weights(spark, d):
    """One judge per nation: preferences from the suppliers' balances."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("judge")).agg(F.avg("s_acctbal").alias("b"))
    w = [F.lit(1.0), 1 + F.abs("b") / 2000, F.lit(3.0), 1 + F.abs("b") / 5000]
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (w[i] / w[j]).alias("a")) for i in range(4) for j in range(4)]
    )
    out = L.pairwise_weights(L.valid_judgements(s.select("judge", F.inline(cells))))
    # consistent judgements: the principal vector is the preferences themselves, the index is 0
    return rnd(out, 6).withColumn("ci", F.col("ci") + 0.0).withColumn("cr", F.col("cr") + 0.0)


_JUDGED = "(1+i%4+abs(b)/(2000*(1+i)))/(1+j%4+abs(b)/(2000*(1+j)))"


@query(
    "judgement_consistency",
    f"""WITH RECURSIVE s AS (SELECT s_nationkey AS judge, avg(s_acctbal) AS b FROM supplier GROUP BY 1),
    m AS (SELECT judge, list_transform(range(0,11), lambda i: list_transform(range(0,11), lambda j: CASE WHEN i=j THEN 1.0::DOUBLE
      WHEN i<j THEN {_JUDGED}*(1+(7*i+3*j+judge)%5) ELSE {_JUDGED}/(1+(7*j+3*i+judge)%5) END)) AS m FROM s),
    it AS (SELECT judge, m, list_transform(m, lambda r: 1.0::DOUBLE/11) AS v, 0 AS k FROM m UNION ALL
      SELECT judge, m, list_transform(u, lambda x: x/list_sum(u)), k+1 FROM (SELECT judge, m, k, list_transform(m, lambda r: list_inner_product(r, v)) AS u FROM it WHERE k<100)),
    l AS (SELECT judge, list_sum(list_transform(m, lambda r: list_inner_product(r, v))) AS lam FROM it WHERE k=100)
    SELECT judge, round(lam,6) AS lambda_max, round((lam-11)/10,6) AS ci, round((lam-11)/10/1.49,6) AS cr FROM l""",
)
def judgement_consistency(spark, d):
    """Eleven criteria judged inconsistently: more than the table of random indices has."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("judge")).agg(F.avg("s_acctbal").alias("b"))
    n = F.sequence(F.lit(0), F.lit(10))
    pairs = s.withColumn("i", F.explode(n)).withColumn("j", F.explode(n))
    slip = F.expr("1 + (7 * least(i, j) + 3 * greatest(i, j) + judge) % 5")
    a = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("i") < F.col("j"), F.expr(_JUDGED) * slip).otherwise(F.expr(_JUDGED) / slip)
    out = L.pairwise_weights(pairs.select("judge", "i", "j", a.alias("a")))
    return rnd(out.select("judge", "lambda_max", "ci", "cr").distinct(), 6)
