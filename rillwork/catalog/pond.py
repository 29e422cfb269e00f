"""Pond design, ranked sites, terrain products and exports over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rillwork.catalog import climate as CC
from rillwork.catalog import terrain as CT
from rillwork.catalog.base import query, table
from rillwork.catalog.climate import rnd
from rillwork.functions import pond as P
from rillwork.operators import climate as C
from rillwork.operators import design as D
from rillwork.plans import design as PD
from rillwork.plans import terrain as PT
from rillwork.session import cut

_V = "{d}/3.0*({l}*{w}+greatest({l}-4*{d},0)*greatest({w}-4*{d},0)+sqrt({l}*{w}*greatest({l}-4*{d},0)*greatest({w}-4*{d},0)))"


def vol(length: str, width: str, depth: str) -> str:
    return _V.format(l=length, w=width, d=depth)


def sites(spark, d):
    """A target storage per supplier."""
    t = F.greatest(F.lit(P.MIN_STORAGE_M3), F.abs("s_acctbal") * 4)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), t.alias("target"))


DES = f"""s AS (SELECT s_suppkey AS site, greatest(2000.0::DOUBLE, abs(s_acctbal)*4) AS target FROM supplier),
    gr AS (SELECT site, target, 1.5::DOUBLE+0.25*i AS depth, a::DOUBLE AS aspect FROM s CROSS JOIN (SELECT unnest(range(0,9)) AS i) CROSS JOIN (VALUES (1.0),(1.5),(2.0)) v(a)),
    bs AS (SELECT 0 AS k, site, target, depth, aspect, 4*depth+5 AS lo, 2000.0::DOUBLE AS hi FROM gr WHERE {vol("aspect*(4*depth+5)", "(4*depth+5)", "depth")}<=target
      UNION ALL SELECT k+1, site, target, depth, aspect, CASE WHEN {vol("aspect*((lo+hi)/2)", "((lo+hi)/2)", "depth")}<target THEN (lo+hi)/2 ELSE lo END,
        CASE WHEN {vol("aspect*((lo+hi)/2)", "((lo+hi)/2)", "depth")}<target THEN hi ELSE (lo+hi)/2 END FROM bs WHERE k<80),
    cd AS (SELECT site, target, depth, aspect, hi AS w, aspect*hi AS l FROM bs WHERE k=80 AND hi-4*depth>=5 AND aspect*hi-4*depth>=5),
    ce AS (SELECT *, (depth+0.5)/3.0*((l+2)*(w+2)+(l-4*depth)*(w-4*depth)+sqrt((l+2)*(w+2)*(l-4*depth)*(w-4*depth))) AS exc, 4.0*2*(l+w) AS emb FROM cd),
    cc AS (SELECT *, 160*exc+220*emb AS cost FROM ce),
    bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round_even(cost,0), l*w, depth, aspect) AS r FROM cc) WHERE r=1)"""


@query(
    "design_candidates",
    f"WITH RECURSIVE {DES} SELECT site, depth, aspect, round(w,4) AS width, round(exc,3) AS excavation_m3, round(emb,3) AS embankment_m3, round(cost,1) AS cost FROM cc",
)
def design_candidates(spark, d):
    c = D.candidates(sites(spark, d), "target")
    return c.select(
        "site", "depth", "aspect", F.round("width", 4).alias("width"), F.round("excavation_m3", 3).alias("excavation_m3"),
        F.round("embankment_m3", 3).alias("embankment_m3"), F.round("cost", 1).alias("cost"),
    )


@query("cheapest_design", f"WITH RECURSIVE {DES} SELECT site, depth, aspect, round(w,4) AS width, round(l,4) AS length, round(cost,1) AS cost FROM bb")
def cheapest_design(spark, d):
    b = D.cheapest_design(D.candidates(sites(spark, d), "target"), ["site"])
    return b.select(
        "site", "depth", "aspect", F.round("width", 4).alias("width"), F.round("length", 4).alias("length"), F.round("cost", 1).alias("cost")
    )


@query(
    "pond_level_table",
    f"""WITH RECURSIVE {DES}, lv AS (SELECT bb.*, i*0.25::DOUBLE AS h FROM bb JOIN (SELECT unnest(range(0,15)) AS i) ON i*0.25<=depth),
    a AS (SELECT site, h, (l-4*depth+4*h)*(w-4*depth+4*h) AS ar, (l-4*depth)*(w-4*depth) AS a2 FROM lv)
    SELECT site, h AS level_m, round(ar,3) AS area_m2, round(h/3.0*(ar+a2+sqrt(ar*a2)),3) AS volume_m3 FROM a""",
)
def pond_level_table(spark, d):
    b = cut(D.cheapest_design(D.candidates(sites(spark, d), "target"), ["site"]))
    return rnd(D.level_table(b, ["site"]), 3)


@query(
    "spillway_sizes",
    """WITH s AS (SELECT s_suppkey AS site, 40+s_nationkey*3.0::DOUBLE AS p, abs(s_acctbal)/10 AS len, s_nationkey/200.0::DOUBLE AS sl, 50000.0+s_acctbal*20 AS a FROM supplier),
    t AS (SELECT *, 0.0195::DOUBLE*pow(greatest(len,30),0.77)*pow(greatest(sl,0.001),-0.385) AS tc FROM s), i AS (SELECT *, p*pow(greatest(tc/60,0.1)/24,1/3.0::DOUBLE)/greatest(tc/60,0.1) AS it FROM t),
    q AS (SELECT *, 0.35::DOUBLE*(it/1000/3600)*a AS pk FROM i)
    SELECT site, round(tc,6) AS tc_min, round(it,6) AS intensity, round(pk,6) AS peak, round(greatest(pk/(1.7::DOUBLE*pow(0.3::DOUBLE,1.5)),1),6) AS weir FROM q""",
)
def spillway_sizes(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("site"), (40 + F.col("s_nationkey") * 3.0).alias("rain_25y"), (F.abs("s_acctbal") / 10).alias("longest_m"),
        (F.col("s_nationkey") / 200.0).alias("slope_ratio"), (50000.0 + F.col("s_acctbal") * 20).alias("area_m2"), F.lit(0.35).alias("coefficient"),
    )
    return rnd(s.select("site", D.spillway_of(s).alias("s")).select("site", "s.*"), 6)


@query(
    "target_storage",
    """SELECT s_suppkey AS site, least(greatest(s_acctbal*7,2000.0),50000.0)::DOUBLE AS target, s_acctbal*7>50000 AS capped FROM supplier""",
)
def target_storage(spark, d):
    t = P.target_storage(F.col("s_acctbal") * 7)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), t.alias("t")).select("site", "t.*")


@query(
    "pond_footprints",
    """WITH s AS (SELECT s_suppkey AS site, s_nationkey*3.0::DOUBLE AS lon, s_acctbal/200 AS lat, 60.0::DOUBLE AS l, 40.0::DOUBLE AS w FROM supplier)
    SELECT site, k, round(lon+sx*l/2/(111320*cos(radians(lat))),8) AS lon, round(lat+sy*w/2/111320,8) AS lat FROM s CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1),(4,-1,-1)) c(k,sx,sy)""",
)
def pond_footprints(spark, d):
    s = table(spark, d, "supplier")
    ring = P.footprint(F.col("s_nationkey") * 3.0, F.col("s_acctbal") / 200, F.lit(60.0), F.lit(40.0))
    return rnd(s.select(F.col("s_suppkey").alias("site"), F.posexplode(ring).alias("k", "p")).select("site", "k", "p.*"), 8)


def design_sites(spark, d):
    """The rain sites as pond sites."""
    p = CC.runoff_params(spark, d)
    return p.select(
        "site", "cn", "coefficient", (150_000.0 + 20_000.0 * F.col("site")).alias("area_m2"), (300.0 + 50 * F.col("site")).alias("longest_m"),
        (F.lit(0.01) + F.col("site") * 0.005).alias("slope_ratio"),
    )


_SOLVE = re.sub(r"\b(gr|cd)\b", r"d\1", DES.split("FROM supplier),", 1)[1])
_GAUGED = CC.RUNOFF.replace("/1e5", "/1e4")  # wetter gauges, so that the targets differ
_PONDS = f"""{CT.G}, {CT._FAR}, {CT._EF}, {CT._SLOPE}, {CT._ME}, {_GAUGED},
    ann AS (SELECT site, year(day) AS year, max(mm) AS peak FROM rain GROUP BY 1,2 HAVING count(mm)>={CC.MIN_DAYS}),
    st AS (SELECT site AS gauge, count(*) AS years, CASE WHEN count(*)<3 THEN max(peak) ELSE avg(peak)+stddev_samp(peak)*sqrt(6.0)/pi()*(-0.5772156649-ln(-ln(1-1/25.0::DOUBLE))) END AS rain_25y FROM ann GROUP BY 1),
    hs AS (SELECT ca.*, point%8 AS gauge, dependable_75/1000*area_m2*0.6 AS harvest FROM ca JOIN ms ON ms.site=point%8 AND method='scs_cn'),
    s AS (SELECT point AS site, least(greatest(harvest,2000.0::DOUBLE),50000.0::DOUBLE) AS target FROM hs), {_SOLVE},
    bp AS (SELECT bb.*, gauge, area_m2, {vol("bb.l", "bb.w", "bb.depth")} AS cap FROM bb JOIN hs ON hs.point=bb.site),
    pq AS (SELECT site AS gauge, day, row_number() OVER (PARTITION BY site ORDER BY day) AS i, [3.2,4.5,6.8,9.5,11.0,8.0,4.6,4.0,4.4,4.8,3.6,3.0][month(day)]::DOUBLE AS pan,
      CASE WHEN mm-0.2::DOUBLE*{CC._S}>0 THEN pow(mm-0.2::DOUBLE*{CC._S},2)/(mm-0.2::DOUBLE*{CC._S}+{CC._S}) ELSE 0.0 END AS q FROM rain),
    bal AS (SELECT site, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS day, 0.0::DOUBLE AS s, 0.0::DOUBLE AS over, 0.0::DOUBLE AS evap, 0.0::DOUBLE AS seep FROM bp
      UNION ALL SELECT site, i, day, raw-greatest(raw-cap,0), greatest(raw-cap,0), evap, seep FROM (
        SELECT b.site, pq.i, pq.day, cap, 0.7::DOUBLE*pan/1000*surf AS evap, 2.0::DOUBLE/1000*surf AS seep,
          greatest(s+q/1000*area_m2*0.6::DOUBLE-0.7::DOUBLE*pan/1000*surf-2.0::DOUBLE/1000*surf,0) AS raw FROM (
          SELECT bal.i, bal.s, bp.*, CASE WHEN s>0 THEN (l-4*depth+4*least(depth*sqrt(s/cap),depth))*(w-4*depth+4*least(depth*sqrt(s/cap),depth)) ELSE 0 END AS surf FROM bal JOIN bp USING (site)) b
        JOIN pq ON pq.gauge=b.gauge AND pq.i=b.i+1)),
    py AS (SELECT bal.site, bool_or(s>=0.9*cap) AS filled, count(DISTINCT month(day)) FILTER (s>0.15*cap) AS months, sum(over) AS spill, sum(evap) AS evap, sum(seep) AS seep
      FROM bal JOIN bp USING (site) WHERE bal.i>0 GROUP BY bal.site, year(day)),
    ps AS (SELECT site, count(*) FILTER (filled)::DOUBLE/count(*) AS rel, avg(months) AS months, avg(spill) AS spill, avg(evap) AS evap, avg(seep) AS seep FROM py GROUP BY 1),
    nv AS (SELECT DISTINCT ca.cell AS outlet, ca.cell, z AS z0, k, z+k AS lvl FROM ca JOIN g USING (cell) CROSS JOIN (SELECT unnest(range(1,5)) AS k)),
    np AS (SELECT * FROM nv UNION SELECT p.outlet, b.cell, p.z0, p.k, p.lvl FROM np p JOIN g a ON a.cell=p.cell JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 WHERE b.z>=p.z0 AND b.z<p.lvl),
    nt AS (SELECT outlet, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY k) AS natural_m3 FROM (SELECT outlet, k, round(sum((lvl-g.z)*100),0) AS v FROM np JOIN g USING (cell) GROUP BY 1,2) GROUP BY 1),
    sw AS (SELECT hs.point AS site, greatest(0.0195::DOUBLE*pow(greatest(longest_m,30),0.77)*pow(greatest(tan(radians(mean_slope)),0.001),-0.385)/60,0.1) AS h, rain_25y, years FROM hs JOIN st USING (gauge)),
    sp AS (SELECT sw.*, (0.25::DOUBLE+0.05*(site%8))*(rain_25y*pow(h/24,1/3.0::DOUBLE)/h/1000/3600)*hs.area_m2 AS peak FROM sw JOIN hs ON hs.point=site)"""


def pond_points(spark, d):
    """The pour points, each with a rain gauge."""
    return CT.pour_points(spark, d).withColumn("gauge", (F.col("point") % 8).cast("long"))


def pond_ground(spark, d):
    """Curve number, coefficient and assumptions of each pour point."""
    gauge, point = (F.col("point") % 8).cast("long"), F.col("point")
    codes = F.array_compact(F.array(F.when(point % 5 == 0, F.lit("soil_assumed")), F.when(point % 7 == 0, F.lit("stale_data"))))
    return CT.pour_points(spark, d).select("raster", "point", (70.0 + 2 * gauge).alias("cn"), (0.25 + 0.05 * gauge).alias("coefficient"), codes.alias("codes"))


@query(
    "pond_designs",
    f"""WITH RECURSIVE {_PONDS} SELECT hs.point, hs.cell AS outlet, hs.area_m2, round(band_pct,4) AS band_pct, natural_m3, round(harvest,2) AS harvestable_m3, round(s.target,2) AS target, depth, aspect,
      round(l,3) AS length, round(w,3) AS width, round(cap,2) AS storage_m3, round(cap-0.15*cap,2) AS live_m3, round(0.15*cap,2) AS dead_m3, round(exc,2) AS excavation_m3, round(emb,2) AS embankment_m3,
      round(cost,0) AS cost, round(rel,4) AS fill_reliability, round(ps.months,4) AS months_with_water, round(ps.spill,2) AS spill_m3, round(ps.evap,2) AS evaporation_m3, round(ps.seep,2) AS seepage_m3,
      round(peak,5) AS peak_m3_s, round(greatest(peak/(1.7::DOUBLE*pow(0.3::DOUBLE,1.5)),1),5) AS weir_m, CASE WHEN hs.point%5=0 OR band_pct>25 THEN 'low' ELSE 'moderate' END AS confidence,
      array_to_string(list_filter([CASE WHEN harvest>50000 THEN 'storage_capped' END, CASE WHEN rel<0.75 THEN 'reliability_below_target' END, CASE WHEN years<20 THEN 'short_record' END,
        CASE WHEN touches_edge THEN 'catchment_truncated' END, CASE WHEN dist>0 THEN 'pour_point_snapped' END, CASE WHEN hs.point%5=0 THEN 'soil_assumed' END, CASE WHEN hs.point%7=0 THEN 'stale_data' END],
        lambda x: x IS NOT NULL), ',') AS notes, NULL::VARCHAR AS reject
    FROM hs JOIN s ON s.site=hs.point JOIN bp ON bp.site=hs.point JOIN ps ON ps.site=hs.point JOIN nt ON nt.outlet=hs.cell JOIN sp ON sp.site=hs.point""",
)
def pond_designs(spark, d):
    rain = CC.rain(spark, d, 1e4).withColumnRenamed("site", "gauge")
    out = PD.pond_designs(
        CT.grid(spark, d).drop("cell"), CT.K, pond_points(spark, d), CT.cols(), CT.CELL, rain, pond_ground(spark, d),
        snap_m=40.0, min_area=CT.MIN_CHANNEL * CT.CELL**2, min_days=CC.MIN_DAYS,
    )
    two = ("harvestable_m3", "target", "storage_m3", "live_m3", "dead_m3", "excavation_m3", "embankment_m3", "spill_m3", "evaporation_m3", "seepage_m3")
    digits = {**dict.fromkeys(two, 2), "band_pct": 4, "length": 3, "width": 3, "cost": 0, "fill_reliability": 4, "months_with_water": 4, "peak_m3_s": 5, "weir_m": 5}
    out = out.withColumns({c: F.round(c, n) for c, n in digits.items()})
    whole = F.transform("natural_m3", lambda v: F.round(v, 0).cast("long").cast("string"))
    return out.withColumns({"natural_m3": F.concat_ws(",", whole), "notes": F.concat_ws(",", "notes")}).drop("raster")


@query(
    "runoff_job",
    f"""WITH {CC.RUNOFF}, v AS (SELECT *, mean_depth/1000*(150000+20000*site) AS vol FROM ms)
    SELECT site, round(100*(max(vol)-min(vol))/greatest(avg(vol),1e-9),4) AS spread_pct, 'scs_cn' AS method,
      round(max(vol) FILTER (method='scs_cn'),4) AS volume_m3, round(max(dependable_75) FILTER (method='scs_cn'),4) AS dependable_75 FROM v GROUP BY 1""",
)
def runoff_job(spark, d):
    areas = design_sites(spark, d).select("site", "area_m2")
    _, span = PD.runoff_job(CC.rain(spark, d), CC.runoff_params(spark, d), areas, CC.MIN_DAYS)
    return rnd(span, 4)


def _rows(spark, d):
    n = table(spark, d, "part").count() // CT.WIDTH  # parquet footer count
    return F.lit(n)


_SITES = f"""WITH RECURSIVE {CT._FILL}, gf AS (SELECT cell, row, col, filled AS z, 0 AS size FROM fd),
    sc AS (WITH RECURSIVE g AS (SELECT * FROM gf), {CT.WALK}, me AS (SELECT dst AS cell, count(*) AS acc, bool_or(fl.rim) AS fed FROM wk JOIN fl ON fl.cell=wk.src GROUP BY 1), {CT._EF}, {CT._SLOPE}
      SELECT sf.cell, sf.row, sf.col, sf.z, acc, fed, tan(radians(slope))*100 AS slope_pct, ln(greatest(acc*10.0::DOUBLE,10)/greatest(hyp,0.001)) AS twi FROM sf JOIN me USING (cell)),
    fg AS (SELECT *, acc>=200 AS river, EXISTS (SELECT 1 FROM sc m WHERE m.acc>=50 AND pow(m.row-sc.row,2)+pow(m.col-sc.col,2)<4) AS belt,
      row<3 OR col<3 OR col>=37 OR row>=(SELECT count(*)//40 FROM part)-3 AS edge FROM sc WHERE acc>=10),
    ok AS (SELECT *, slope_pct<=15 AND NOT river AS ok, slope_pct<=15 AND NOT river AND NOT belt AND NOT edge AS base FROM fg),
    al AS (SELECT *, bool_or(base AND NOT fed) OVER () OR NOT bool_or(base) OVER () AS complete FROM ok),
    el AS (SELECT * FROM al WHERE base AND (NOT complete OR NOT fed)),
    pl AS (SELECT cell AS site, z AS z0, cell FROM el UNION SELECT p.site, p.z0, b.cell FROM pl p JOIN sc a ON a.cell=p.cell JOIN sc b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1
      WHERE b.z>=p.z0 AND b.z<p.z0+2),
    vo AS (SELECT site, sum((z0+2-z)*100) AS volume_m3, count(*)*100.0::DOUBLE AS area_m2 FROM pl JOIN sc USING (cell) GROUP BY 1),
    cr AS (SELECT *, volume_m3/area_m2 AS efficiency, log10(greatest(acc*0.01::DOUBLE,0.001)) AS la, greatest(least((15-slope_pct)/12,1.0::DOUBLE),0) AS s_flatness FROM el JOIN vo ON vo.site=el.cell),
    cs AS (SELECT *, greatest(least((la-log10(0.02::DOUBLE))/(log10(0.1::DOUBLE)-log10(0.02::DOUBLE)), 1, (log10(2.0::DOUBLE)-la)/(log10(2.0::DOUBLE)-log10(0.5::DOUBLE))),0) AS s_upstream_area,
      CASE WHEN max(twi) OVER ()-min(twi) OVER ()<1e-12 THEN 0 ELSE (twi-min(twi) OVER ())/(max(twi) OVER ()-min(twi) OVER ()) END AS s_wetness,
      CASE WHEN max(efficiency) OVER ()-min(efficiency) OVER ()<1e-12 THEN 0 ELSE (efficiency-min(efficiency) OVER ())/(max(efficiency) OVER ()-min(efficiency) OVER ()) END AS s_impoundment FROM cr),
    so AS (SELECT *, 0.35*s_upstream_area+0.2*s_flatness+0.15*s_wetness+0.3*s_impoundment AS score FROM cs),
    od AS (SELECT *, row_number() OVER (ORDER BY score DESC, cell) AS o FROM so),
    rk AS (SELECT 1 AS rank, o, [o] AS os FROM od WHERE o=1 UNION ALL
      SELECT rank+1, o, list_append(os, o) FROM (SELECT rk.rank, rk.os, c.o, row_number() OVER (ORDER BY c.o) AS b FROM rk JOIN od c
        ON NOT EXISTS (SELECT 1 FROM od k WHERE list_contains(rk.os, k.o) AND sqrt(pow(k.row-c.row,2)+pow(k.col-c.col,2))<5) WHERE rk.rank<5) WHERE b=1)"""


@query(
    "ranked_sites",
    f"""{_SITES} SELECT cell AS id, row, col, rank, acc*100.0::DOUBLE AS upstream_m2, {", ".join(f"round({c},5) AS {c}" for c in
      ("score", "slope_pct", "twi", "volume_m3", "area_m2", "efficiency", "s_upstream_area", "s_flatness", "s_wetness", "s_impoundment"))} FROM rk JOIN od USING (o)""",
)
def ranked_sites(spark, d):
    best, _ = PT.rank_sites(
        CT.grid(spark, d).drop("cell"), CT.K, _rows(spark, d), CT.cols(), CT.CELL, stream_area=1000.0, belt_m=20.0, apart_m=50.0,
        area_ha=(0.02, 0.1, 0.5, 2.0),
    )
    return rnd(best.drop("raster"), 5)


@query(
    "site_exclusions",
    f"""{_SITES} SELECT count(*) FILTER (base AND (NOT complete OR NOT fed)) AS considered, count(*) FILTER (ok AND belt)+count(*) FILTER (river) AS river_cells,
      count(*) FILTER (base AND fed AND complete) AS edge_fed_cells, round(max(acc*0.01::DOUBLE),5) AS max_area_ha, bool_or(complete) AS catchments_complete FROM al""",
)
def site_exclusions(spark, d):
    _, counts = PT.rank_sites(
        CT.grid(spark, d).drop("cell"), CT.K, _rows(spark, d), CT.cols(), CT.CELL, stream_area=1000.0, belt_m=20.0, apart_m=50.0,
        area_ha=(0.02, 0.1, 0.5, 2.0),
    )
    return rnd(counts.drop("raster"), 5)


_WATERED = _SITES.replace("acc>=200 AS river", "(acc>=200 OR fw.size%9=0) AS river").replace("fg AS (SELECT *,", "fw AS (SELECT p_partkey AS cell, p_size AS size FROM part), fg AS (SELECT sc.*,").replace(
    "FROM sc WHERE acc>=10)", "FROM sc JOIN fw USING (cell) WHERE acc>=10)"
).replace("NOT belt AND NOT edge AS base", "NOT belt AND NOT edge AND col<30 AS base")
_RANKING = {"belt_m": 20.0, "apart_m": 50.0, "area_ha": (0.02, 0.1, 0.5, 2.0)}


@query(
    "ranked_sites_inside",
    f"""{_WATERED} SELECT cell AS id, row, col, rank, round(score,5) AS score, round(volume_m3,5) AS volume_m3 FROM rk JOIN od USING (o)""",
)
def ranked_sites_inside(spark, d):
    """Sites inside an area of interest and off mapped water."""
    g = CT.grid(spark, d).select("raster", "row", "col", "z", (F.col("size") % 9 == 0).alias("water"), (F.col("col") < 30).alias("inside"))
    best, _ = PT.rank_sites(g, CT.K, _rows(spark, d), CT.cols(), CT.CELL, stream_area=1000.0, **_RANKING)
    return rnd(best.select("id", "row", "col", "rank", "score", "volume_m3"), 5)


def _source(lift: str) -> str:
    """Cells with accumulation and rank, and the way of every cell, of one height source."""
    sites = _SITES.replace(CT.G, CT.G.replace("p_retailprice+p_size*0.5", f"p_retailprice+p_size*0.5{lift}"))
    return f"""({sites}, wz AS (WITH RECURSIVE g AS (SELECT * FROM gf), {CT.WALK} SELECT src, dst FROM wk),
      rd AS (SELECT rank, cell FROM rk JOIN od USING (o))
      SELECT sc.cell, sc.row, sc.col, sc.acc, rd.rank, NULL::BIGINT AS dst FROM sc LEFT JOIN rd USING (cell) UNION ALL SELECT src, NULL, NULL, NULL, NULL, dst FROM wz)"""


_LIFT = "+(p_partkey%7)*0.3"
_CROSS = f"""WITH aa AS MATERIALIZED {_source("")}, ab AS MATERIALIZED {_source(_LIFT)},
    ca AS (SELECT * FROM aa WHERE dst IS NULL), cb AS (SELECT * FROM ab WHERE dst IS NULL)"""
_LONGCROSS = f"""{_CROSS}, st AS (SELECT 'a' AS side, rank, cell AS id, row, col FROM ca WHERE rank IS NOT NULL UNION ALL SELECT 'b', rank, cell, row, col FROM cb WHERE rank IS NOT NULL),
    al AS (SELECT 'a' AS source, cell, row, col, acc FROM ca WHERE acc>=10 UNION ALL SELECT 'b', cell, row, col, acc FROM cb WHERE acc>=10),
    sn AS (SELECT * FROM (SELECT side, rank, id, source, al.cell, acc, row_number() OVER (PARTITION BY side, rank, source ORDER BY sqrt(pow((al.row-st.row)*10.0::DOUBLE,2)+pow((al.col-st.col)*10.0::DOUBLE,2))-1e-6*acc, al.cell) AS k FROM st CROSS JOIN al) WHERE k=1),
    wy AS (SELECT 'a' AS source, cell AS src, dst FROM aa WHERE dst IS NOT NULL UNION ALL SELECT 'b', cell, dst FROM ab WHERE dst IS NOT NULL),
    cc AS (SELECT side, rank, sn.source, src FROM sn JOIN wy ON wy.source=sn.source AND wy.dst=sn.cell),
    ov AS (SELECT side, rank, count(*) FILTER (n=2)::DOUBLE/count(*) AS overlap FROM (SELECT side, rank, src, count(*) AS n FROM cc GROUP BY 1,2,3) GROUP BY 1,2),
    pt AS (SELECT x.side, x.rank, y.rank AS partner, count(*) AS n FROM cc x JOIN cc y ON y.src=x.src AND x.side<>y.side AND x.side=x.source AND y.side=y.source GROUP BY 1,2,3),
    pb AS (SELECT side, rank, max_by(partner, {{'n':n,'p':-partner}}) AS partner FROM pt GROUP BY 1,2)"""


def _sources(spark, d):
    g = CT.grid(spark, d).select("raster", "row", "col", "z", "cell")
    return g.drop("cell"), g.withColumn("z", F.col("z") + (F.col("cell") % 7) * 0.3).drop("cell")


@query(
    "source_cross_check",
    f"""{_LONGCROSS}, h AS (SELECT p_retailprice+p_size*0.5 AS z, p_retailprice+p_size*0.5{_LIFT} AS y FROM part),
    f AS (SELECT count(*) AS n, round(avg(y-z),6) AS bias, round(sqrt(avg(pow(y-z,2))),6) AS rmse, round(stddev_pop(y-z),6) AS rmse_unbiased, round(corr(z,y),6) AS r FROM h),
    ff AS (SELECT f.*, {", ".join(f"(SELECT round(avg(CASE WHEN y.cell IS NULL THEN 0.0::DOUBLE ELSE 1 END),6) FROM (SELECT x.cell, min(y.cell) AS cell_1 FROM {x} x LEFT JOIN {y} y ON y.acc>={m} AND abs(y.row-x.row)<={k} AND abs(y.col-x.col)<={k} WHERE x.acc>={m} GROUP BY 1) y(x_cell, cell)) AS {n}" for n, x, y, m, k in (("hit_a", "ca", "cb", 10, 1), ("hit_b", "cb", "ca", 10, 1), ("major_hit", "ca", "cb", 40, 2)))},
      (SELECT round(max(acc)*0.01::DOUBLE,6) FROM ca) AS outlet_a_ha, (SELECT round(max(acc)*0.01::DOUBLE,6) FROM cb) AS outlet_b_ha,
      (SELECT round(sqrt(pow(x.row-y.row,2)+pow(x.col-y.col,2))*10.0::DOUBLE,6) FROM ca x, cb y WHERE x.rank=1 AND y.rank=1) AS top_distance_m FROM f)
    SELECT st.side, st.rank, st.id, round(sa.acc*0.01::DOUBLE,6) AS area_a_ha, round(sb.acc*0.01::DOUBLE,6) AS area_b_ha, round(overlap,6) AS overlap, partner, ff.*
    FROM ff CROSS JOIN st JOIN sn sa ON sa.side=st.side AND sa.rank=st.rank AND sa.source='a' JOIN sn sb ON sb.side=st.side AND sb.rank=st.rank AND sb.source='b'
    JOIN ov ON ov.side=st.side AND ov.rank=st.rank LEFT JOIN pb ON pb.side=st.side AND pb.rank=st.rank""",
)
def source_cross_check(spark, d):
    """How far two height sources agree, beside the ranked sites of both, their catchments and partners."""
    a, b = _sources(spark, d)
    facts, sites = PT.source_cross_check(
        a, b, CT.K, _rows(spark, d), CT.cols(), CT.CELL, stream_area=1000.0, major_area=4000.0, snap_m=40.0, min_area=1000.0, **_RANKING
    )
    return rnd(sites.join(facts, CT.K).drop("raster"), 6)


_PRODUCTS = f"""WITH RECURSIVE {CT._FILL}, gf AS (SELECT cell, row, col, filled AS z, 0 AS size FROM fd),
    pr AS (WITH RECURSIVE g AS (SELECT * FROM gf), {CT.WALK}, ac AS (SELECT dst AS cell, count(*) AS acc FROM wk GROUP BY 1), {CT._EF}, {CT._SLOPE}, {CT._CURV}
      SELECT cv.cell, cv.z, slope, CASE WHEN hyp>=1e-9 THEN CASE WHEN degrees(atan2(dx,dy))<0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END END AS aspect,
      round_even(1+254*least(greatest(cos(radians(45))*cos(atan(hyp))+sin(radians(45))*sin(atan(hyp))*cos(radians(315)-atan2(dx,dy)),0),1),0) AS shade,
      ln(greatest(acc*10.0::DOUBLE,10)/greatest(hyp,0.001)) AS twi, log10(acc::DOUBLE) AS log_acc,
      CASE WHEN cg*cg+ch*ch<1e-12 THEN 0 ELSE -2*(cd*cg*cg+ce*ch*ch+cf*cg*ch)/(cg*cg+ch*ch)*100 END AS profile,
      CASE WHEN cg*cg+ch*ch<1e-12 THEN 0 ELSE -2*(cd*ch*ch+ce*cg*cg-cf*cg*ch)/(cg*cg+ch*ch)*100 END AS plan FROM cv JOIN ac USING (cell))"""


@query(
    "terrain_product_cells",
    f"{_PRODUCTS} SELECT cell, {', '.join(f'round({c},5)+0 AS {c}' for c in ('z', 'slope', 'aspect', 'shade', 'twi', 'log_acc', 'profile', 'plan'))} FROM pr",
)
def terrain_product_cells(spark, d):
    cells, _ = PT.terrain_products(CT.grid(spark, d).drop("cell"), CT.K, CT.cols(), CT.CELL)
    layers = ("z", "slope", "aspect", "shade", "twi", "log_acc", "profile", "plan")
    return cells.select("cell", *[(F.round(c, 5) + 0.0).alias(c) for c in layers])


@query(
    "terrain_products",
    f"""{_PRODUCTS}, v AS (UNPIVOT (SELECT z, slope, shade, twi, log_acc FROM pr) ON z, slope, shade, twi, log_acc INTO NAME layer VALUE v),
    q AS (SELECT layer, count(*) AS n, quantile_cont(v,0.02) AS lo, quantile_cont(v,0.98) AS hi FROM v GROUP BY 1)
    SELECT layer, n, round(lo,5) AS lo, round(CASE WHEN hi<=lo THEN lo+1 ELSE hi END,5) AS hi FROM q""",
)
def terrain_products(spark, d):
    _, limits = PT.terrain_products(CT.grid(spark, d).drop("cell"), CT.K, CT.cols(), CT.CELL)
    return rnd(limits.drop("raster"), 5)


@query(
    "proposal_sheet",
    """WITH o AS (SELECT o_custkey AS site, sum(o_totalprice) AS cost, max(o_totalprice) AS storage, count(*) AS depth FROM orders GROUP BY 1)
    SELECT site, unnest(['gross_storage','depth','indicative_cost']) AS item, unnest([round(storage,2)::VARCHAR, depth::VARCHAR, round(cost/1000,0)::BIGINT::VARCHAR]) AS value FROM o""",
)
def proposal_sheet(spark, d):
    from rillwork.sources.sinks import proposal_rows

    price = F.col("o_totalprice").cast("decimal(28,8)")  # sums of doubles depend on their order, which decides ties
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("site")).agg(
        F.sum(price).alias("cost"), F.max("o_totalprice").alias("storage"), F.count(F.lit(1)).alias("depth")
    )
    return proposal_rows(
        o, "site",
        {
            "gross_storage": F.round("storage", 2).cast("string"),
            "depth": F.col("depth").cast("string"),
            "indicative_cost": F.expr("cast(round(cost, -3) as long) div 1000").cast("string"),
        },
    )


@query(
    "rain_documents_round_trip",
    f"WITH {CC.RAIN} SELECT site, day, CASE WHEN mm>=0.5 THEN mm END AS mm FROM rain",
)
def rain_documents_round_trip(spark, d):
    """Daily rain written as keyed JSON documents, one per site and year, and parsed back."""
    from rillwork.sources.climate import keyed_rain

    r = CC.rain(spark, d)
    mm = F.when(F.col("mm") >= 0.5, F.col("mm")).otherwise(-999.0)
    docs = r.groupBy("site", F.year("day").alias("year")).agg(  # at most 366 entries
        F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd"), mm))).alias("m")
    )
    js = F.to_json(F.struct(F.struct(F.struct(F.col("m").alias("PRECTOTCORR")).alias("parameter")).alias("properties")))
    return keyed_rain(docs.select("site", js.alias("doc")), "doc").select("site", "day", "mm")
