"""Road network over ``part`` (nodes on a 40-wide grid) with ``supplier`` as query points."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import query, table
from rillwork.catalog.climate import rnd
from rillwork.operators import network as N
from rillwork.operators import tiles as TI
from rillwork.session import cut

WIDTH = 40
STEP = 1.0 / (WIDTH - 1)


def cols():
    return F.lit(WIDTH).cast("long")


def nodes(spark, d):
    """A node per part on the unit grid, 1-based ids, category from the brand's last digit."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("node"),
        (F.col("p_partkey") + 1).alias("id"),
        (F.floor(F.col("p_partkey") / WIDTH) * F.lit(STEP)).alias("lat"),
        ((F.col("p_partkey") % WIDTH) * F.lit(STEP)).alias("lon"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
    )


def links(spark, d):
    """Roads between grid neighbours whose sizes differ by at most 30."""
    n = nodes(spark, d).select("node", "size")
    # two columns of a small file are planned as a broadcast, but unpacked they fill the driver: sides are shuffled
    a = n.select(F.col("node").alias("src"), F.col("size").alias("a")).hint("merge")
    b = n.select(F.col("node").alias("dst"), F.col("size").alias("b")).hint("merge")
    return N.onward_pairs(n, cols()).join(a, "src").join(b, "dst").filter(F.abs(F.col("a") - F.col("b")) <= 30).select("src", "dst")


def requests(spark, d, k=10):
    """One query per supplier."""
    kinds = F.array(*[F.lit(c) for c in ("ECONOMY", "PROMO", "SMALL", "STANDARD", "LARGE")])
    q = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("query"),
        ((F.col("s_nationkey") * 2 + F.col("s_suppkey") % 5) * F.lit(STEP) + F.lit(0.003)).alias("lat"),
        ((F.col("s_suppkey") * 7 % WIDTH) * F.lit(STEP) - F.lit(0.002)).alias("lon"),
        F.get(kinds, (F.col("s_suppkey") % 5).cast("int")).alias("category"),
        (F.lit(0.05) + (F.col("s_suppkey") % 7) * F.lit(0.02)).alias("rad"),
        F.lit(k).alias("k"),
    )
    # the grid is not square here: snap by the same rounding without clamping to a square
    node = (F.floor(F.col("lat") * (WIDTH - 1) + 0.5) * WIDTH
            + F.least(F.greatest(F.floor(F.col("lon") * (WIDTH - 1) + 0.5), F.lit(0)), F.lit(WIDTH - 1))).cast("long")
    return q.withColumn("source", node)


NET = f"""nd AS (SELECT p_partkey AS node, p_partkey+1 AS id, (p_partkey//40)*{STEP!r}::DOUBLE AS lat, (p_partkey%40)*{STEP!r}::DOUBLE AS lon, p_type AS category, p_size AS size FROM part),
    pr AS (SELECT node AS src, node+1 AS dst FROM nd WHERE node%40<39 UNION ALL SELECT node, node+40 FROM nd),
    lk AS (SELECT src, dst FROM pr JOIN nd a ON a.node=src JOIN nd b ON b.node=dst WHERE abs(a.size-b.size)<=30),
    ed AS (SELECT src, dst FROM lk UNION SELECT dst, src FROM lk),
    rq AS (SELECT *, CAST(floor(lat*39+0.5)*40+least(greatest(floor(lon*39+0.5),0),39) AS BIGINT) AS source FROM (SELECT s_suppkey AS query, (s_nationkey*2+s_suppkey%5)*{STEP!r}::DOUBLE+0.003 AS lat, (s_suppkey*7%40)*{STEP!r}::DOUBLE-0.002 AS lon,
      ['ECONOMY','PROMO','SMALL','STANDARD','LARGE'][CAST(s_suppkey%5+1 AS INTEGER)] AS category, 0.05::DOUBLE+(s_suppkey%7)*0.02::DOUBLE AS rad, 10 AS k FROM supplier)),
    ir AS (SELECT query, node, id, sqrt(pow(nd.lat-rq.lat,2)+pow(nd.lon-rq.lon,2)) AS euclid FROM rq JOIN nd USING (category) WHERE sqrt(pow(nd.lat-rq.lat,2)+pow(nd.lon-rq.lon,2))<=rad+1e-6)"""


@query("missing_roads", f"WITH {NET} SELECT pr.src, pr.dst FROM pr JOIN nd ON nd.node=pr.dst WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.src=pr.src AND lk.dst=pr.dst)")
def missing_roads(spark, d):
    return N.missing_roads(nodes(spark, d), links(spark, d), cols())


@query(
    "road_degrees",
    f"WITH {NET}, g AS (SELECT nd.node, count(ed.dst) AS degree FROM nd LEFT JOIN ed ON ed.src=nd.node GROUP BY 1) SELECT degree, count(*) AS nodes FROM g GROUP BY 1",
)
def road_degrees(spark, d):
    return N.degrees(nodes(spark, d), N.undirected(links(spark, d)))


@query(
    "road_components",
    f"""WITH RECURSIVE {NET}, cc AS (SELECT 0 AS k, node, node AS root FROM nd UNION ALL
      SELECT k+1, node, root FROM (SELECT max(cc.k) AS k, x.node, min(cc.root) AS root FROM cc JOIN (SELECT src AS node, dst AS o FROM ed UNION ALL SELECT node, node FROM nd) x ON x.o=cc.node GROUP BY x.node) WHERE k<250)
    SELECT root, count(*) AS nodes FROM cc WHERE k=250 GROUP BY 1""",
)
def road_components(spark, d):
    n = nodes(spark, d).select(F.lit("g").alias("net"), "node")
    e = N.undirected(links(spark, d)).select(F.lit("g").alias("net"), F.col("src").alias("a"), F.col("dst").alias("b"))
    roots = TI.connect(e, ["net"])
    return n.join(roots, ["net", "node"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.count(F.lit(1)).alias("nodes")
    )


@query(
    "network_profile",
    f"""WITH {NET} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM lk) AS roads, (SELECT count(DISTINCT category) FROM nd) AS categories,
    (SELECT count(*) FROM lk)-(SELECT count(*) FROM nd)+1 AS loops,
    (SELECT count(*) FROM pr JOIN nd ON nd.node=pr.dst WHERE pr.dst=pr.src+1)-(SELECT count(*) FROM lk WHERE dst=src+1) AS missing_across,
    (SELECT count(*) FROM pr JOIN nd ON nd.node=pr.dst WHERE pr.dst=pr.src+40)-(SELECT count(*) FROM lk WHERE dst=src+40) AS missing_down""",
)
def network_profile(spark, d):
    n, lk = nodes(spark, d), cut(links(spark, d))
    across = F.col("dst") == F.col("src") + 1
    m = N.missing_roads(n, lk, cols()).groupBy().agg(
        F.count(F.when(across, 1)).alias("missing_across"), F.count(F.when(~across, 1)).alias("missing_down")
    )
    a = n.groupBy().agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("category").alias("categories"))
    r = lk.groupBy().agg(F.count(F.lit(1)).alias("roads"))
    one = F.lit(1).alias("_k")
    row = a.select("*", one).join(r.select("*", one), "_k").join(m.select("*", one), "_k").drop("_k")
    return row.withColumn("loops", F.col("roads") - F.col("nodes") + 1)


@query("road_categories", f"WITH {NET} SELECT category, count(*) AS nodes FROM nd GROUP BY 1")
def road_categories(spark, d):
    return nodes(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("nodes"))


@query("places_in_radius", f"WITH {NET} SELECT query, node, id, round(euclid,9) AS euclid FROM ir")
def places_in_radius(spark, d):
    return rnd(N.in_radius(requests(spark, d), nodes(spark, d)), 9)


def bfs_sql(edges: str = "ed") -> str:
    return "dm(source, node, hops) USING KEY (source, node) AS (SELECT DISTINCT source, source AS node, 0 AS hops FROM rq UNION SELECT dm.source, e.dst, min(dm.hops)+1 FROM dm JOIN {0} e ON e.src=dm.node LEFT JOIN recurring.dm r ON r.source=dm.source AND r.node=e.dst WHERE r.node IS NULL GROUP BY 1,2)".format(
        edges
    )


_ANS = """an AS (SELECT * FROM (SELECT ir.query, ir.node, ir.id, euclid, dm.hops, CAST(row_number() OVER (PARTITION BY ir.query ORDER BY dm.hops, euclid, ir.id) AS INTEGER) AS rank
      FROM ir JOIN rq USING (query) JOIN dm ON dm.source=rq.source AND dm.node=ir.node) WHERE rank<=10)"""


@query("nearest_by_road", f"WITH RECURSIVE {NET}, {bfs_sql()}, {_ANS} SELECT query, node, id, round(euclid,9) AS euclid, hops, rank FROM an")
def nearest_by_road(spark, d):
    q, members = N.alike(requests(spark, d))
    a, _, _ = N.search(q, nodes(spark, d), N.undirected(links(spark, d)), cols())
    return N.for_all(rnd(a, 9), members)


@query("nearest_by_one_way_road", f"WITH RECURSIVE {NET}, {bfs_sql('lk')}, {_ANS} SELECT query, node, id, round(euclid,9) AS euclid, hops, rank FROM an")
def nearest_by_one_way_road(spark, d):
    q, members = N.alike(requests(spark, d))
    a, _, _ = N.search(q, nodes(spark, d), links(spark, d), cols(), both_ways=False)
    return N.for_all(rnd(a, 9), members)


def _rank_sql(key: str) -> str:
    return f"""WITH {NET}, j AS (SELECT ir.query, ir.node, ir.id, euclid, {key} AS key FROM ir JOIN rq USING (query) JOIN nd ON nd.node=ir.node),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY key, euclid, id) AS INTEGER) AS rank FROM j)
    SELECT query, rank, node, id, round(key,9) AS key, round(euclid,9) AS euclid FROM r WHERE rank<=10"""


@query("nearest_by_line", _rank_sql("euclid"))
def nearest_by_line(spark, d):
    return rnd(N.rank_by(requests(spark, d), nodes(spark, d), lambda c: c["euclid"]), 9)


def _manhattan(c):
    # rounded so that equal step counts tie whatever the order of additions
    return F.round(F.abs(c["place_lat"] - c["lat"]) + F.abs(c["place_lon"] - c["lon"]), 9)


@query("nearest_by_manhattan", _rank_sql("round(abs(nd.lat-rq.lat)+abs(nd.lon-rq.lon),9)"))
def nearest_by_manhattan(spark, d):
    return rnd(N.rank_by(requests(spark, d), nodes(spark, d), _manhattan), 9)


@query(
    "routes_of_answers",
    f"""WITH RECURSIVE {NET}, {bfs_sql()}, {_ANS}, pt AS (SELECT d.source, d.node, min(e.src) AS parent FROM dm d JOIN ed e ON e.dst=d.node JOIN dm u ON u.source=d.source AND u.node=e.src AND u.hops=d.hops-1 GROUP BY 1,2),
    wk AS (SELECT query, source, an.node AS target, an.node, an.hops AS pos FROM an JOIN rq USING (query) UNION ALL SELECT query, wk.source, target, pt.parent, pos-1 FROM wk JOIN pt ON pt.source=wk.source AND pt.node=wk.node)
    SELECT query, target, node, pos FROM wk""",
)
def routes_of_answers(spark, d):
    q, members = N.alike(requests(spark, d))
    a, dist, _ = N.search(q, nodes(spark, d), N.undirected(links(spark, d)), cols(), parents=True)
    return N.for_all(N.routes(a, dist), members)


@query(
    "described_answers",
    f"""WITH RECURSIVE {NET}, {bfs_sql()}, {_ANS} SELECT query, rank, an.id, p.category, hops, round(hops*{STEP!r}::DOUBLE,9) AS road_distance, round(euclid,9) AS straight_line,
      round(abs(p.lat-s.lat)+abs(p.lon-s.lon),9) AS manhattan, round(CASE WHEN sqrt(pow(p.lat-s.lat,2)+pow(p.lon-s.lon,2))>0 THEN hops*{STEP!r}::DOUBLE/sqrt(pow(p.lat-s.lat,2)+pow(p.lon-s.lon,2)) ELSE 1 END,9) AS detour_factor,
      round(sqrt(pow(s.lat-rq.lat,2)+pow(s.lon-rq.lon,2)),9) AS snap_offset FROM an JOIN rq USING (query) JOIN nd p ON p.node=an.node JOIN nd s ON s.node=rq.source""",
)
def described_answers(spark, d):
    q, members = N.alike(requests(spark, d))
    a, _, _ = N.search(q, nodes(spark, d), N.undirected(links(spark, d)), cols())
    return N.for_all(rnd(N.describe(a, q, nodes(spark, d), F.lit(STEP)), 9), members)


def _detours(spark, d):
    q = requests(spark, d).select("query", F.col("source").alias("node"))
    q = cut(q.join(nodes(spark, d).select("node"), "node", "left_semi"))
    return N.detours(N.detour_counts(q, N.undirected(links(spark, d)), WIDTH))


_DET = f"""{NET}, {bfs_sql()}, r0 AS (SELECT query, abs(dm.node//40-rq.source//40)+abs(dm.node%40-rq.source%40) AS steps, hops FROM rq JOIN dm USING (source) WHERE rq.source IN (SELECT node FROM nd)),
    r AS (SELECT *, hops::DOUBLE/steps AS ratio FROM r0 WHERE steps >= 1)"""


@query("detours_by_length", f"WITH RECURSIVE {_DET} SELECT steps, count(*) AS pairs, round(avg(CASE WHEN ratio=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS same_share FROM r GROUP BY 1")
def detours_by_length(spark, d):
    return rnd(_detours(spark, d)[0], 6)


@query(
    "detour_distribution",
    f"""WITH RECURSIVE {_DET}, k AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS rn, count(*) OVER () AS n FROM r)
    SELECT count(*) AS pairs, round(avg(CASE WHEN ratio=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS same_share, round(avg(ratio),6) AS mean, round(max(ratio),6) AS max,
      round(max(ratio) FILTER (rn-1=CAST(floor(0.9::DOUBLE*(n-1)) AS BIGINT)),6) AS p90, round(max(ratio) FILTER (rn-1=CAST(floor(0.99::DOUBLE*(n-1)) AS BIGINT)),6) AS p99 FROM k""",
)
def detour_distribution(spark, d):
    return rnd(_detours(spark, d)[1], 6)


@query(
    "ranking_quality",
    f"""WITH RECURSIVE {NET}, {bfs_sql()}, {_ANS}, ln AS (SELECT * FROM (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY euclid, id) AS rank FROM ir) WHERE rank<=10),
    al AS (SELECT 'road' AS name, query, node FROM an UNION ALL SELECT 'line', query, node FROM ln), b AS (SELECT query, max(hops) AS bar, count(*) AS want FROM an GROUP BY 1),
    p AS (SELECT name, query, count(*) FILTER (dm.hops<=bar) AS score, max(want) AS want FROM al JOIN b USING (query) JOIN rq USING (query) LEFT JOIN dm ON dm.source=rq.source AND dm.node=al.node GROUP BY 1,2)
    SELECT name, count(*) AS queries, round(avg(score::DOUBLE/want),6) AS mean_score, round(avg(CASE WHEN score=want THEN 1.0::DOUBLE ELSE 0 END),6) AS full_share FROM p GROUP BY 1""",
)
def ranking_quality(spark, d):
    (q, members), n = N.alike(requests(spark, d)), nodes(spark, d)
    a, dist, _ = N.search(q, n, N.undirected(links(spark, d)), cols())
    a = cut(a)
    line = N.rank_by(q, n, lambda c: c["euclid"])
    both = a.select(F.lit("road").alias("name"), "query", "node").unionByName(
        line.select(F.lit("line").alias("name"), "query", "node")
    )
    return rnd(N.ranking_quality(both, a, dist, members), 6)


@query(
    "accepted_queries",
    """SELECT s_suppkey AS query, lower(s_name) AS category FROM supplier WHERE FALSE UNION ALL
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey%11<>0 AND c_acctbal>=0 AND c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey=3)""",
)
def accepted_queries(spark, d):
    c = table(spark, d, "customer")
    q = c.select(
        F.col("c_custkey").alias("query"),
        F.when(F.col("c_custkey") % 11 == 0, "not a number").otherwise(F.lit("0.5")).alias("lat"),
        F.lit("0.25").alias("lon"),
        F.col("c_acctbal").cast("string").alias("rad"),
        F.col("c_mktsegment").alias("category"),
    )
    known = c.filter("c_nationkey = 3").select(F.col("c_mktsegment").alias("category"))
    return N.valid_queries(q, known).select("query", "category")
