import math

import numpy as np
from pyspark.sql import functions as F

from rillwork.functions import geo
from rillwork.functions import units as U
from rillwork.operators import land as L
from rillwork.operators import spatial as S


def test_projection_of_known_points(spark):
    # the central meridian has easting 500 000; the equator has northing 0
    r = spark.range(1).select(
        geo.utm_epsg(F.lit(81.0), F.lit(21.0)).alias("e"), geo.to_utm(F.lit(81.0), F.lit(0.0), F.lit(32644)).alias("p"),
        geo.from_utm(F.lit(412345.0), F.lit(2345678.0), F.lit(32644)).alias("q"),
    ).first()
    assert r["e"] == 32644 and abs(r["p"]["x"] - 500000) < 1e-6 and abs(r["p"]["y"]) < 1e-6
    back = spark.range(1).select(geo.to_utm(F.lit(r["q"]["lon"]), F.lit(r["q"]["lat"]), F.lit(32644)).alias("p")).first()["p"]
    assert abs(back["x"] - 412345) < 1e-3 and abs(back["y"] - 2345678) < 1e-3


def test_radius_join_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [(i, *map(float, p)) for i, p in enumerate(rng.random((40, 2)).round(3))]
    b = [(i, *map(float, p)) for i, p in enumerate(np.vstack([rng.random((60, 2)), rng.random((60, 2)) * 0.05]).round(3))]
    pa = spark.createDataFrame([("k", *r) for r in a], "k string, id long, x double, y double").withColumn("rad", F.lit(0.01) + F.col("id") * 0.01)
    pb = spark.createDataFrame([("k", *r) for r in b], "k string, place long, x double, y double")
    got = {(r["id"], r["place"]) for r in S.radius_join(pa, pb, ("x", "y"), ["k"], "rad").collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 0.01 + i * 0.01}
    assert got == want
    near = S.nearest_k(pa.drop("rad"), pb, ("x", "y"), ["k"], "id", 4, 0.02, ["place"]).collect()
    for i, x, y in a:
        mine = [r["place"] for r in sorted((r for r in near if r["id"] == i), key=lambda r: r["rank"])]
        assert mine == [j for _, j in sorted((math.hypot(x - u, y - v), j) for j, u, v in b)[:4]]


def test_hull_area(spark):
    rng = np.random.default_rng(6)
    pts = [("a", float(x), float(y)) for x, y in rng.random((500, 2)) * 10] + [("a", *c) for c in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))]
    got = S.hull_area(spark.createDataFrame(pts, "k string, x double, y double"), ["k"], pieces=7).first()
    assert abs(got["hull_area"] - 100) < 1e-9


def test_densify_steps(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)])], "id long, v array<struct<x:double,y:double>>")
    rows = S.densify(df, "id", "v", 4.0).orderBy("k").collect()
    want = np.linspace(0, 15, math.ceil(15 / 4) + 1)
    at = [r["x"] if r["y"] == 0 else 10 + r["y"] for r in rows]
    assert np.allclose(at, want)


def test_polygon_clip_counts_touched_cells(spark):
    cells = spark.createDataFrame([(r, c) for r in range(6) for c in range(6)], "row int, col int")
    ring = [(1.2, 1.2), (3.4, 1.2), (3.4, 2.8), (1.2, 2.8)]
    edges = [(1, *ring[i], *ring[(i + 1) % 4]) for i in range(4)]
    e = spark.createDataFrame(edges, "id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["row"], r["col"]) for r in S.polygon_cells(cells, e, "id").collect()}
    assert got == {(r, c) for r in (1, 2) for c in (1, 2, 3)}


def test_weights_and_consistency(spark):
    good = [[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]]
    odd = [[1, 9, 1 / 9], [1 / 9, 1, 9], [9, 1 / 9, 1]]
    rows = [(j, i, k, float(m[i][k])) for j, m in (("good", good), ("odd", odd)) for i in range(3) for k in range(3)]
    rows += [("broken", 0, 1, 2.0), ("broken", 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "judge string, i int, j int, a double")
    out = L.pairwise_weights(L.valid_judgements(df)).collect()
    assert {r["judge"] for r in out} == {"good", "odd"}
    w = [r["weight"] for r in sorted((r for r in out if r["judge"] == "good"), key=lambda r: r["criterion"])]
    assert np.allclose(w, [4 / 7, 2 / 7, 1 / 7])
    assert all(r["cr"] > L.ACCEPTABLE_CR for r in out if r["judge"] == "odd")
    assert all(abs(r["cr"]) < 1e-9 for r in out if r["judge"] == "good")


def test_rule_algebra_keeps_names(spark):
    a, b = L.Rule.of("a", F.col("x") > 1), L.Rule.of("b", F.col("x") < 5)
    r = (a & ~b) | b
    assert r.names == ["a", "not (b)", "b"]
    df = spark.createDataFrame([(0,), (3,), (9,)], "x int")
    assert [x["e"] for x in df.select((a & b).rejected_by().alias("e")).collect()] == [["a"], [], ["b"]]


def test_quantities(spark):
    q = U.quantity(F.lit(12345.678), "m2", 15.0)
    r = spark.range(1).select(U.convert(q, "ha").alias("h"), U.display(q).alias("t"), U.low(q).alias("lo")).first()
    assert abs(r["h"]["value"] - 1.2345678) < 1e-12 and r["t"] == "12,345.68 m2 (±15 %)" and abs(r["lo"] - 10493.8263) < 1e-6
