"""Points, grids and boundaries over ``supplier`` and ``part``: snapping, cells, centroids, missing heights, machine load."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog import land as CL
from rillwork.catalog import terrain as CT
from rillwork.catalog.base import query, table
from rillwork.catalog.climate import rnd
from rillwork.functions import geo
from rillwork.functions import load as L
from rillwork.functions.terrain import SIDES
from rillwork.operators import focal as FO
from rillwork.operators import network as N
from rillwork.operators import spatial as S
from rillwork.sources import rejects

SIDE = 25


def _points(spark, d):
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 101) / 100.0 * 1.2 - 0.1).alias("lat"), ((F.col("s_suppkey") * 7 % 101) / 100.0 * 1.2 - 0.1).alias("lon")
    )


_PT = "p AS (SELECT s_suppkey AS id, (s_suppkey%101)/100.0::DOUBLE*1.2::DOUBLE-0.1::DOUBLE AS lat, (s_suppkey*7%101)/100.0::DOUBLE*1.2::DOUBLE-0.1::DOUBLE AS lon FROM supplier)"


def _node(v: str) -> str:
    return f"least(greatest(floor({v}*{SIDE - 1}+0.5::DOUBLE),0),{SIDE - 1})"


@query("snapped_points", f"WITH {_PT} SELECT id, CAST({_node('lat')}*{SIDE}+{_node('lon')} AS BIGINT) AS source FROM p")
def snapped_points(spark, d):
    """The grid node of every asked point; points outside go to the border."""
    return N.snapped(_points(spark, d), F.lit(SIDE).cast("long")).select("id", "source")


@query(
    "cells_of_points",
    f"""WITH {_PT}, c AS (SELECT id, lon*1000 AS x, lat*1000 AS y, CAST(floor((1000-lat*1000)/30) AS BIGINT) AS row, CAST(floor(lon*1000/30) AS BIGINT) AS col FROM p)
    SELECT id, CASE WHEN ok THEN row END AS row, CASE WHEN ok THEN col END AS col, CASE WHEN ok THEN round((col+0.5)*30::DOUBLE,6) END AS x, CASE WHEN ok THEN round(1000-(row+0.5)*30::DOUBLE,6) END AS y,
      CASE WHEN NOT ok THEN 'outside' END AS reason FROM (SELECT *, row BETWEEN 0 AND 33 AND col BETWEEN 0 AND 33 AS ok FROM c)""",
)
def cells_of_points(spark, d):
    """The cell of every projected point and its centre; a point off the grid keeps its row and a reason."""
    x0, y1, cell = F.lit(0.0), F.lit(1000.0), F.lit(30.0)
    p = _points(spark, d).select("id", geo.cell_of(F.col("lon") * 1000, F.col("lat") * 1000, x0, y1, cell).alias("c")).select("id", "c.*")
    p = rejects.tag(p, {"outside": ~(F.col("row").between(0, 33) & F.col("col").between(0, 33))})
    p = p.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("row", "col")})
    return rnd(p.select("id", "row", "col", geo.cell_centre(F.col("row"), F.col("col"), x0, y1, cell).alias("m"), "reason").select("id", "row", "col", "m.*", "reason"), 6)


@query(
    "boundary_facts",
    """WITH r AS (SELECT s_suppkey AS id, (s_suppkey%4)::DOUBLE AS h, s_suppkey::DOUBLE AS o FROM supplier),
    v AS (SELECT id, h, o, unnest([0.0,4.0,4.0,1.0])::DOUBLE+o AS x, unnest([0.0,0.0,h,CASE WHEN h=0 THEN 0.0 ELSE h+1 END])::DOUBLE AS y, unnest([1,2,3,4]) AS i FROM r),
    n AS (SELECT a.id, a.x, a.y, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.id=a.id AND b.i=a.i%4+1),
    s AS (SELECT id, sum(x*y2-x2*y) AS a, sum((x+x2)*(x*y2-x2*y)) AS cx, sum((y+y2)*(x*y2-x2*y)) AS cy, avg(x) AS mx, avg(y) AS my FROM n GROUP BY 1)
    SELECT id, round(abs(a)/2,6) AS area, round(CASE WHEN abs(a)>1e-12 THEN cx/(3*a) ELSE mx END,6) AS x, round(CASE WHEN abs(a)>1e-12 THEN cy/(3*a) ELSE my END,6) AS y FROM s""",
)
def boundary_facts(spark, d):
    """Area and centroid of one boundary per supplier, some without area."""
    s = table(spark, d, "supplier")
    h, o = (F.col("s_suppkey") % 4).cast("double"), F.col("s_suppkey").cast("double")
    zero = F.lit(0.0)
    top = F.when(h == 0, zero).otherwise(h + 1)
    at = lambda x, y: F.struct((o + x).alias("x"), y.alias("y"))
    ring = F.array(at(0.0, zero), at(4.0, zero), at(4.0, h), at(1.0, top))
    got = s.select(F.col("s_suppkey").alias("id"), ring.alias("r")).select("id", geo.shoelace(F.col("r")).alias("area"), geo.centroid(F.col("r")).alias("c"))
    return rnd(got.select("id", "area", "c.*"), 6)


@query("grid_resolution", "SELECT s_suppkey AS id, round(least(greatest(abs(s_acctbal)/10/4,5.0),30.0)::DOUBLE,6) AS cell_m FROM supplier")
def grid_resolution(spark, d):
    """Cell size from the spacing of contours, kept within 5 and 30 metres."""
    s = table(spark, d, "supplier")
    return rnd(s.select(F.col("s_suppkey").alias("id"), geo.resolution(F.abs("s_acctbal") / 10, 5.0, 30.0).alias("cell_m")), 6)


@query(
    "heights_without_gaps",
    f"""WITH {CT.G}, h AS (SELECT row, col, cell, CASE WHEN size%11<>0 THEN z END AS z FROM g), f AS (SELECT row, col, cell, coalesce(z,avg(z) OVER ()) AS z, 0 AS size FROM h),
    nb AS (SELECT a.cell, a.z, count(*) AS cells, avg(b.z) AS mean FROM f a JOIN f b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY 1,2)
    SELECT cell, round(z,5) AS z, cells, round(mean,5) AS mean FROM nb""",
)
def heights_without_gaps(spark, d):
    """Missing heights take the raster's mean before the 3 x 3 window reads them."""
    g = CT.grid(spark, d).withColumn("z", F.when(F.col("size") % 11 != 0, F.col("z")))
    nb = FO.neighbours(FO.fill_nodata(g.select("raster", "row", "col", "cell", "z"), CT.K), CT.K)
    all_ = [F.col("z"), *[F.col(s) for s in SIDES]]
    n = sum((c.isNotNull().cast("long") for c in all_), F.lit(0).cast("long"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in all_), F.lit(0.0))
    return rnd(nb.select("cell", "z", n.alias("cells"), (total / n).alias("mean")), 5)


@query(
    "box_outcomes",
    f"""SELECT CASE WHEN area_km2<2000 THEN 'too_small' WHEN area_km2>30000 THEN 'too_large' ELSE 'accepted' END AS outcome, count(*) AS n
    FROM ({CL.BOX_FACTS_SQL}) GROUP BY 1""",
)
def box_outcomes(spark, d):
    """Boxes by the rule on their area: accepted, or the reason why not."""
    c = (F.col(x) for x in ("west", "south", "east", "north"))
    f = CL.boxes(spark, d).select("id", geo.box_facts(*c, 100.0).alias("f")).select("id", "f.*")
    return rejects.account(S.checked_area(f, 2000, 30000))


@query(
    "measured_load",
    """WITH s AS (SELECT s_suppkey AS id, abs(s_acctbal)/100 AS cpu, CASE WHEN s_suppkey%3>0 THEN s_suppkey%90 END AS machine, s_suppkey%4 AS cores, CASE WHEN s_suppkey%5>0 THEN s_suppkey/10.0::DOUBLE END AS load, s_suppkey%3 AS weight FROM supplier),
    c AS (SELECT *, greatest(greatest(cpu::DOUBLE,coalesce(machine,0))/100, least(coalesce(load,0)/greatest(cores,1),4)) AS c FROM s)
    SELECT id, round(c,6) AS cpu_load, round(greatest(c,(id%40)/32.0::DOUBLE,0.0)*CASE WHEN id%7=0 THEN 1.5 ELSE 1 END/greatest(weight,1),6) AS load_index FROM c""",
)
def measured_load(spark, d):
    """Load index of a machine from its own samples, with weights."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        k.alias("id"), (F.abs("s_acctbal") / 100).alias("cpu"), F.when(k % 3 > 0, k % 90).cast("double").alias("machine"),
        (k % 4).alias("cores"), F.when(k % 5 > 0, k / 10.0).alias("load"), (k % 3).alias("weight"),
    )
    cpu = L.cpu_load(F.col("cpu"), F.col("machine"), F.col("cores"), F.col("load"))
    idx = L.load_index(cpu, F.col("id") % 40, F.lit(None).cast("double"), F.col("id") % 7 == 0, F.col("weight"), 32, 500)
    return rnd(s.select("id", cpu.alias("cpu_load"), idx.alias("load_index")), 6)
