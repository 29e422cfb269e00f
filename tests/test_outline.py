import json

import numpy as np
from pyspark.sql import functions as F

from rillwork.operators import outline as OL
from rillwork.sources import sinks

KEYS = ["raster", "label"]


def _cells(spark, grid):
    rows = [("r", int(v), i, j) for i, line in enumerate(grid) for j, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "raster string, label long, row int, col int")


def _plain(grid):
    """Rings by walking: (label, corner list from the smallest edge on)."""
    sides = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))
    h, w = grid.shape
    out = []
    for label in np.unique(grid[grid > 0]):
        edges = {}
        for i, j in zip(*np.nonzero(grid == label)):
            for d, (n, s, e) in enumerate(sides):
                a, b = i + n[0], j + n[1]
                if not (0 <= a < h and 0 <= b < w and grid[a, b] == label):
                    edges[(i + s[0], j + s[1], d)] = (i + e[0], j + e[1])
        while edges:
            start = now = min(edges)
            ring = []
            while True:
                end = edges.pop(now)
                ring.append(now)
                now = next(k for k in ((*end, (now[2] + t) % 4) for t in (1, 0, 3)) if k in edges or k == start)
                if now == start:
                    break
            area = sum(c if d == 1 else -c if d == 3 else 0 for _, c, d in ring)
            corners = [(int(c), int(r)) for k, (r, c, d) in enumerate(ring) if d != ring[k - 1][2]]
            out.append((int(label), len(ring), area, corners))
    return sorted(out)


def test_rings_of_random_labels_match_a_walk(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 3, (17, 23))  # corners that touch, holes, single cells
    grid[5:12, 5:15] = 1
    grid[7:9, 8:11] = 0
    spiral = np.zeros((17, 12), int)
    spiral[0, :], spiral[:, 11], spiral[16, :], spiral[2:, 0], spiral[2, :10], spiral[2:15, 9], spiral[14, 2:10] = 9, 9, 9, 9, 9, 9, 9
    grid = np.hstack([grid, np.zeros((17, 1), int), spiral])
    rings = OL.outline_rings(_cells(spark, grid), KEYS).cache()
    facts = OL.ring_facts(rings, KEYS, 10.0)
    made = sinks.ring_features(OL.ring_vertices(rings, KEYS), facts, KEYS, F.col("col"), F.col("row")).collect()
    got = []
    for r in made:
        f = json.loads(r["feature"])
        ring = [tuple(p) for p in f["geometry"]["coordinates"][0]]
        assert ring[0] == ring[-1] and len(ring) - 1 == r["corners"]
        assert f["properties"]["area_m2"] == r["area_m2"] and r["hole"] == (r["area_m2"] < 0)
        got.append((r["label"], r["edges"], round(r["area_m2"] / 100), ring[:-1]))
    assert sorted(got) == _plain(grid)
    areas = {r["label"]: r["a"] for r in facts.groupBy("label").agg(F.sum("area_m2").alias("a")).collect()}
    assert areas == {int(k): 100.0 * int((grid == k).sum()) for k in np.unique(grid[grid > 0])}


def test_no_cells_have_no_rings(spark):
    none = _cells(spark, [[1]]).limit(0)
    rings = OL.outline_rings(none, KEYS)
    assert rings.count() == 0 and OL.ring_facts(rings, KEYS, 1.0).count() == 0


def _walked(rings):
    got = {}
    for r in rings.collect():
        got.setdefault((r["label"], r["ring"]), []).append((r["pos"], r["row"], r["col"], r["dir"]))
    out = []
    for (label, _), ring in got.items():
        ring.sort()
        assert [p for p, *_ in ring] == list(range(len(ring)))
        area = sum(c if d == 1 else -c if d == 3 else 0 for _, _, c, d in ring)
        out.append((label, len(ring), area, [(c, r) for k, (_, r, c, d) in enumerate(ring) if d != ring[k - 1][3]]))
    return sorted(out)


def test_rings_across_many_tiles_match_a_walk(spark):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 4, (13, 19))
    grid[2:11, 3:16] = 1
    grid[4:6, 6:9] = 0
    for tile in (1, 4):
        assert _walked(OL.outline_rings(_cells(spark, grid), KEYS, tile=tile)) == _plain(grid)


def test_a_long_ring_inside_a_tile_takes_no_rounds(spark, monkeypatch):
    grid = np.zeros((40, 40), int)
    grid[::2, :] = 1
    grid[1::4, 39] = 1
    grid[3::4, 0] = 1
    cuts = []
    monkeypatch.setattr(OL, "cut", lambda df, real=OL.cut: cuts.append(1) or real(df))
    assert _walked(OL.outline_rings(_cells(spark, grid), KEYS)) == _plain(grid)
    assert len(cuts) <= 6  # eleven doublings of 1 600 edges took two dozen
