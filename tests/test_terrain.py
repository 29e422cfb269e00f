import math

import numpy as np
from conftest import cells
from pyspark.sql import functions as F

from rillwork.operators import flow as FL
from rillwork.operators import focal as FO
from rillwork.operators import pools as PL
from rillwork.operators import tiles as TI
from rillwork.plans import design as PD
from rillwork.plans import terrain as PT

K = ["raster"]
STEPS = [(dr, dc) for _, dr, dc, _ in FO.STEPS]


def filled_by_definition(z, eps):
    """The least surface on which every inner cell is above the ground and has a lower way out.

    Relaxed from infinity until nothing moves: a cell is its ground if a neighbour lies below that, else
    a step above its lowest neighbour. Rim cells (also of holes) are their ground.
    """
    far = np.pad(np.where(np.isnan(z), -np.inf, z), 1, constant_values=-np.inf)
    h, w = z.shape
    around = lambda g: np.stack([g[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in STEPS])
    rim = np.isneginf(around(far)).any(axis=0)
    level = np.where(rim, z, np.inf)
    while True:
        low = around(np.pad(np.where(np.isnan(z), np.inf, level), 1, constant_values=np.inf)).min(axis=0)
        new = np.where(rim, z, np.minimum(level, np.where(z > low, z, low + eps)))
        if np.array_equal(new, level, equal_nan=True):
            return new
        level = new


def test_neighbours_across_tiles(spark):
    z = np.arange(13 * 11).reshape(13, 11) % 17
    got = FO.neighbours(cells(spark, z.tolist()), K, "z", tile=4).collect()
    assert len(got) == z.size
    for r in got:
        for name, dr, dc, _ in FO.STEPS:
            i, j = r["row"] + dr, r["col"] + dc
            want = float(z[i, j]) if 0 <= i < 13 and 0 <= j < 11 else None
            assert r[name] == want


def test_fill_matches_its_definition_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 12, (23, 19)).astype(float)
    z[5:14, 4:15] = 2.0  # a flat lake bed over several tiles
    z[9, 9] = np.nan
    grid = [[None if math.isnan(v) else v for v in line] for line in z.tolist()]
    got = TI.fill_depressions(cells(spark, grid), K, eps=1e-4, tile=5).collect()
    want = filled_by_definition(z, 1e-4)
    assert len(got) == z.size - 1
    assert all(abs(r["filled"] - want[r["row"], r["col"]]) < 1e-9 for r in got)


def test_bowl_with_a_notch_drains_through_it(spark):
    n = 7
    grid = [[float((r - 3) ** 2 + (c - 2) ** 2) for c in range(n)] for r in range(n)]
    notch = min((r, c) for r in range(n) for c in range(n) if r in (0, n - 1) and c == 2)
    grid[notch[0]][notch[1]] = 0.5
    filled = TI.fill_depressions(cells(spark, grid), K).select("raster", "row", "col", F.col("filled").alias("z"))
    f = FO.flow_direction(filled, K, F.lit(n).cast("long"))
    acc = {r["cell"]: r["acc"] for r in FL.accumulate(f, K, sums={"acc": F.lit(1).cast("long")}).collect()}
    assert max(acc, key=acc.get) == notch[0] * n + notch[1] and acc[notch[0] * n + notch[1]] > 20
    drains = {r["cell"]: r["recv"] for r in f.collect()}
    assert all(drains[r * n + c] is not None for r in range(1, n - 1) for c in range(1, n - 1))


def test_components_across_tiles(spark):
    rng = np.random.default_rng(8)
    m = rng.random((21, 18)) < 0.42
    rows = [("r", i, j, i * 18 + j) for i, j in zip(*np.nonzero(m))]
    df = spark.createDataFrame([(a, int(b), int(c), int(d)) for a, b, c, d in rows], "raster string, row int, col int, cell long")
    got = {r["cell"]: r["label"] for r in TI.label_components(df, K, tile=4).collect()}
    lab = {d: d for *_, d in rows}
    moved = True
    while moved:
        moved = False
        for _, i, j, d in rows:
            best = min(lab.get((i + a) * 18 + j + b, 1 << 40) for a, b in [*STEPS, (0, 0)] if 0 <= j + b < 18)
            if best < lab[d]:
                lab[d], moved = best, True
    assert got == lab


def test_mask_distance_is_exact_and_bounded(spark):
    rng = np.random.default_rng(4)
    m = rng.random((17, 22)) < 0.03
    df = cells(spark, m.astype(float).tolist()).withColumn("m", F.col("z") > 0)
    spots = np.argwhere(m)
    for r in TI.mask_distance(df, K, "m", 5, tile=6).collect():
        d2 = min(((spots - [r["row"], r["col"]]) ** 2).sum(axis=1))
        assert r["d2"] == (int(d2) if d2 <= 25 else None)


def test_plane_accumulates_along_rows(spark):
    grid = [[float(20 - c) for c in range(20)] for _ in range(6)]
    f = FO.flow_direction(cells(spark, grid), K, F.lit(20).cast("long"))
    acc = {r["cell"]: r for r in FL.accumulate(f, K, sums={"acc": F.lit(1).cast("long")}, step=FL.step_length(F.lit(20), 10.0)).collect()}
    assert all(acc[r * 20 + c]["acc"] == c + 1 for r in range(6) for c in range(20))
    assert acc[19]["longest"] == 190.0


def test_y_valley_has_order_two(spark):
    # two channels of equal order meet and run on: (cell, receiver)
    left, right = [0, 1, 2], [10, 11, 12]
    edges = [(0, 1), (1, 2), (2, 20), (10, 11), (11, 12), (12, 20), (20, 21), (21, 22), (22, None)]
    acc = {0: 5, 1: 6, 2: 7, 10: 5, 11: 6, 12: 7, 20: 15, 21: 16, 22: 17}
    s = spark.createDataFrame([("r", c, p, acc[c]) for c, p in edges], "raster string, cell long, recv long, acc long")
    links = FL.stream_links(s, K)
    t = FL.link_table(links, K, F.lit(100).cast("long"), 1.0)
    got = {r["link"]: r for r in FL.strahler(t, K).collect()}
    assert {k: v["ord"] for k, v in got.items()} == {0: 1, 10: 1, 20: 2}
    assert got[0]["mouth"] == 20 and got[0]["cells"] == len(left) + 1 and got[20]["cells"] == 3
    assert got[10]["cells"] == len(right) + 1


def test_suppression_equals_the_greedy_pass(spark):
    rng = np.random.default_rng(11)
    pts = [(i, int(a), int(b), float(s)) for i, (a, b, s) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.random(150).round(2)))]
    df = spark.createDataFrame([("r", *p) for p in pts], "raster string, id long, row int, col int, score double")
    chosen = []
    for i, r, c, s in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all(math.hypot(r - a, c - b) >= 9 for _, a, b, _ in chosen):
            chosen.append((i, r, c, s))
    got = [r["id"] for r in FL.suppress_near(df, K, 9.0, 7).orderBy("rank").collect()]
    assert got == [c[0] for c in chosen[:7]]


def test_pool_behind_a_bund(spark):
    # a bowl with a sill: the far hollow fills only once the sill is under water
    z = [[9, 9, 9, 9, 9, 9], [9, 1, 1, 3, 1, 9], [9, 9, 9, 9, 9, 9]]
    sites = spark.createDataFrame([("r", 1, 1, 1)], "raster string, site long, row int, col int")
    curve = {r["level_m"]: r for r in PL.pool_levels(sites, cells(spark, z), K, range(5), 100.0).collect()}
    assert [curve[float(k)]["area_m2"] for k in range(5)] == [0.0, 200.0, 200.0, 400.0, 400.0]
    assert curve[3.0]["volume_m3"] == (3 + 3 + 1 + 3) * 100


def test_pools_of_all_window_sizes(spark):
    """Windows that are outgrown, and water beyond the largest one, give what a flood of the whole raster gives."""
    rng = np.random.default_rng(4)
    z = (rng.random((40, 55)) * 2 + np.abs(np.arange(55) - 25)[None, :] * 0.15 + np.arange(40)[::-1, None] * 0.02).round(3)
    z[10:13, :] = np.nan
    spots = [(k, int(r), int(c)) for k, (r, c) in enumerate(zip(rng.integers(0, 40, 25), rng.integers(0, 55, 25)))] + [(99, 39, 25), (100, 80, 3)]
    want = {}
    for k, r, c in spots:
        if r < 40 and not np.isnan(z[r, c]):
            for level in (0.5, 2.0):
                todo, pool = [(r, c)], {(r, c)}
                while todo:
                    a, b = todo.pop()
                    for n in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if n not in pool and 0 <= n[0] < 40 and 0 <= n[1] < 55 and z[r, c] <= z[n] < z[r, c] + level:
                            pool.add(n)
                            todo.append(n)
                want[k, level] = (len(pool) * 4.0, round(sum(z[r, c] + level - z[n] for n in pool) * 4, 6))
    grid = cells(spark, [[None if np.isnan(v) else v for v in line] for line in z])
    sites = spark.createDataFrame([("r", *s) for s in spots], "raster string, site long, row int, col int")
    for tile, largest in ((64, 256), (8, 256), (8, 32)):
        got = PL.pool_levels(sites, grid, K, [0.5, 2.0], 4.0, tile=tile, largest=largest).collect()
        assert {(r["site"], r["level_m"]): (r["area_m2"], round(r["volume_m3"], 6)) for r in got} == want


def test_catchment_outlines_of_nested_outlets(spark):
    rng = np.random.default_rng(9)
    n, m = 18, 22
    # a random forest on a grid: every cell drains to a neighbour of smaller number, or out of the raster
    recv = {}
    for c in range(n * m):
        r, k = divmod(c, m)
        near = [(r + a) * m + k + b for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= r + a and 0 <= k + b < m and (r + a) * m + k + b < c]
        recv[c] = int(rng.choice(near)) if near and rng.random() > 0.03 else None
    rows = [("r", c // m, c % m, c, d) for c, d in recv.items()]
    flow = spark.createDataFrame(rows, "raster string, row int, col int, cell long, recv long")
    outlets = sorted({int(c) for c in rng.integers(0, n * m, 70)} | {0, 1, 2, 23, 24})

    def way(c):
        while c is not None:
            yield c
            c = recv[c]

    up = {o: {c for c in recv if o in set(way(c))} for o in outlets}
    want = {o: sum((c // m + a, c % m + b) not in {(x // m, x % m) for x in s} for c in s for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for o, s in up.items()}
    got = FL.catchment_edges(flow, K, spark.createDataFrame([("r", o) for o in outlets + outlets[:3]], "raster string, cell long"))
    assert {r["cell"]: r["edges"] for r in got.collect()} == want


def test_points_without_a_pond_keep_their_row(spark):
    rows, cols = 24, 21
    z = [[abs(c - 10) * 1.0 + (rows - r) * 0.2 for c in range(cols)] for r in range(rows)]
    flat = spark.createDataFrame([("flat", r, c, float(r)) for r in range(3) for c in range(3)], "raster string, row int, col int, z double")
    surface = cells(spark, z).drop("cell").unionByName(flat)
    points = spark.createDataFrame([("r", 1, 18, 12, "g"), ("r", 2, 15, 10, "g"), ("r", 3, 15, 10, "dry"), ("flat", 4, 1, 1, "g")], "raster string, point long, row int, col int, gauge string")
    ground = spark.createDataFrame([("r", 1, 80.0, 0.4, ["soil_assumed"]), ("r", 3, 80.0, 0.4, []), ("flat", 4, 80.0, 0.4, [])], "raster string, point long, cn double, coefficient double, codes array<string>")
    rain = spark.sql("select 'g' as gauge, day, if(month(day) in (6, 7, 8), 25.0D, 0.0D) as mm from (select explode(sequence(date'2001-01-01', date'2006-12-31')) as day)")
    got = {r["point"]: r for r in PD.pond_designs(surface, K, points, F.lit(cols).cast("long"), 30.0, rain, ground, snap_m=100.0, min_area=20_000.0).collect()}
    assert {p: r["reject"] for p, r in got.items()} == {1: None, 2: "no_ground", 3: "no_rainfall", 4: "no_channel"}
    one = got[1]
    assert one["confidence"] == "low" and "soil_assumed" in one["notes"] and "pour_point_snapped" in one["notes"]
    assert one["storage_m3"] >= one["target"] * (1 - 1e-6) and math.isclose(one["live_m3"] + one["dead_m3"], one["storage_m3"])
    assert len(one["natural_m3"]) == 4 and sorted(one["natural_m3"]) == one["natural_m3"] and one["natural_m3"][0] > 0


def test_rank_sites_on_a_valley(spark):
    rows, cols = 40, 31
    z = [[abs(c - 15) * 1.0 + (rows - r) * 0.2 for c in range(cols)] for r in range(rows)]
    best, counts = PT.rank_sites(
        cells(spark, z).drop("cell"), K, F.lit(rows), F.lit(cols).cast("long"), 30.0, stream_area=30_000.0, apart_m=120.0, belt_m=60.0
    )
    got = best.orderBy("rank").collect()
    c = counts.first()
    assert got and all(r["col"] == 15 for r in got)
    assert c["considered"] >= len(got) and c["catchments_complete"] in (True, False)
    assert all(a["score"] >= b["score"] for a, b in zip(got, got[1:]))


def test_equal_sources_agree(spark):
    rows, cols = 30, 31
    z = [[abs(c - 15) * 1.0 + (rows - r) * 0.2 for c in range(cols)] for r in range(rows)]
    one = cells(spark, z).drop("cell")
    marked = one.withColumns({"water": F.col("row") == 20, "inside": F.col("row") > 8})
    facts, sites = PT.source_cross_check(
        one, marked, K, F.lit(rows), F.lit(cols).cast("long"), 30.0, stream_area=30_000.0, major_area=60_000.0, snap_m=60.0, min_area=30_000.0,
        apart_m=120.0, belt_m=60.0, top_n=2,
    )
    f = facts.first()
    assert (f["n"], f["bias"], f["rmse"], f["hit_a"], f["hit_b"], f["major_hit"]) == (rows * cols, 0.0, 0.0, 1.0, 1.0, 1.0)
    got = sites.collect()
    assert {r["side"] for r in got} == {"a", "b"} and all(r["overlap"] == 1.0 and r["area_a_ha"] == r["area_b_ha"] and r["partner"] for r in got)
    assert all(r["id"] // cols > 8 and r["id"] // cols != 20 for r in got if r["side"] == "b")


def test_flat_ground_has_no_sites(spark):
    z = [[5.0] * 12 for _ in range(12)]
    best, counts = PT.rank_sites(
        cells(spark, z).drop("cell"), K, F.lit(12), F.lit(12).cast("long"), 30.0, stream_area=1e6
    )
    assert best.count() == 0


def test_a_raster_without_candidates_cuts_no_catchment_off(spark):
    rows = [("steep", 10, 10, 1, True, 40.0, 9, True, None), ("good", 10, 10, 1, True, 2.0, 9, False, None), ("cut", 10, 10, 1, True, 2.0, 9, True, None)]
    df = spark.createDataFrame(rows, "raster string, row int, col int, cell long, stream boolean, slope_pct double, acc long, fed boolean, dist_major double")
    flagged = FL.site_flags(df, K, F.lit(20), F.lit(20), 100.0)
    got = {r["raster"]: (r["considered"], r["catchments_complete"]) for r in FL.site_counts(flagged, K, 100.0).collect()}
    assert got == {"steep": (0, True), "good": (1, True), "cut": (1, False)}


def test_size_estimates_do_not_multiply_over_rounds(spark):
    """Rounds that join a table with itself keep an estimate of the table's size, else planning outgrows the job."""
    n = 300
    rows = [("r", i, i + 1 if i + 1 < n else None) for i in range(n)]
    f = spark.createDataFrame(rows, "raster string, cell long, recv long")
    outlet = spark.createDataFrame([("r", n - 1), ("r", 99)], "raster string, cell long")
    near = FL.roots(f, K, outlet)
    got = {r["cell"]: (r["outlet"], r["steps"]) for r in near.collect()}
    assert got == {i: (99, 99 - i) if i <= 99 else (n - 1, n - 1 - i) for i in range(n)}
    acc = FL.accumulate(f, K, sums={"acc": F.lit(1).cast("long")})
    assert {r["cell"]: r["acc"] for r in acc.collect()} == {i: i + 1 for i in range(n)}
    for df in (near, acc):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
