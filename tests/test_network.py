import random
from collections import deque

from pyspark.sql import functions as F

from rillwork.operators import network as N


def hamlet(spark, roads, side=4):
    """A square of ``side`` x ``side`` nodes with ids from 100; even ones are inns, odd ones wells."""
    nodes = [(v, v + 100, v // side / (side - 1), v % side / (side - 1), "well" if v % 2 else "inn") for v in range(side * side)]
    n = spark.createDataFrame(nodes, "node long, id long, lat double, lon double, category string")
    return n, N.undirected(spark.createDataFrame(roads, "src long, dst long"))


def near_inns(spark, rad, k, at=(0.0, 0.0)):
    q = spark.createDataFrame([(5, *at, "inn", rad, k)], "query long, lat double, lon double, category string, rad double, k int")
    return N.snapped(q, F.lit(4))


def test_only_connected_inns_are_found(spark):
    n, e = hamlet(spark, [(0, 1), (1, 2), (10, 14), (14, 15)])
    a, _, _ = N.search(near_inns(spark, 5.0, 10), n, e, F.lit(4))
    assert [(r["id"], r["hops"]) for r in a.orderBy("rank").collect()] == [(100, 0), (102, 2)]


def test_a_spiral_road_is_walked_to_its_end(spark):
    spiral = [0, 1, 2, 3, 7, 11, 15, 14, 13, 12, 8, 4, 5, 6, 10, 9]
    n, e = hamlet(spark, list(zip(spiral, spiral[1:])))
    a, dist, _ = N.search(near_inns(spark, 5.0, 20), n, e, F.lit(4), parents=True)
    got = {r["id"]: r["hops"] for r in a.collect()}
    assert got == {v + 100: i for i, v in enumerate(spiral) if v % 2 == 0}
    far = N.routes(a.filter("id = 110"), dist).orderBy("pos").collect()
    assert [r["node"] for r in far] == spiral[:15]


def test_full_grid_distance_is_manhattan(spark):
    e = N.full_grid(spark, 6)
    assert e.count() == 2 * 2 * 6 * 5
    src = spark.createDataFrame([(1, 14)], "query long, node long")
    for r in N.hop_distances(src, e).collect():
        assert r["hops"] == abs(r["node"] // 6 - 2) + abs(r["node"] % 6 - 2)


def test_random_cities_match_plain_breadth_first(spark):
    rng = random.Random(7)
    n = 9
    roads = [(a, b) for a in range(n * n) for b in (a + 1, a + n) if b < n * n and (b != a + 1 or b % n) and rng.random() < 0.7]
    cats = [rng.choice("abc") for _ in range(n * n)]
    nodes = spark.createDataFrame(
        [(v, v + 1, v // n / (n - 1), v % n / (n - 1), cats[v]) for v in range(n * n)], "node long, id long, lat double, lon double, category string"
    )
    e = N.undirected(spark.createDataFrame(roads, "src long, dst long"))
    qs = [(i, rng.random(), rng.random(), rng.choice("abc"), rng.uniform(0.1, 0.5), rng.choice([1, 3, 10])) for i in range(25)]
    q = N.snapped(spark.createDataFrame(qs, "query long, lat double, lon double, category string, rad double, k int"), F.lit(n))
    got = {}
    for r in N.search(q, nodes, e, F.lit(n))[0].collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["hops"]))
    adj = {v: [] for v in range(n * n)}
    for a, b in roads:
        adj[a].append(b)
        adj[b].append(a)
    for i, lat, lon, cat, rad, k in qs:
        src = min(max(int(lat * (n - 1) + 0.5), 0), n - 1) * n + min(max(int(lon * (n - 1) + 0.5), 0), n - 1)
        dist, todo = {src: 0}, deque([src])
        while todo:
            v = todo.popleft()
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        hits = []
        for v, hops in dist.items():
            d = ((v // n / (n - 1) - lat) ** 2 + (v % n / (n - 1) - lon) ** 2) ** 0.5
            if cats[v] == cat and d <= rad + 1e-6:
                hits.append((hops, d, v + 1))
        want = [(j + 1, h[2], h[0]) for j, h in enumerate(sorted(hits)[:k])]
        assert sorted(got.get(i, [])) == want


def test_missing_roads_and_bad_queries(spark):
    n, e = hamlet(spark, [(0, 1), (1, 2)])
    assert N.missing_roads(n, e, F.lit(4)).count() == 22
    q = spark.createDataFrame(
        [(1, "0.25", "0.75", "2", "well"), (2, "north", "0.1", "1", "inn"), (3, "0.1", "NaN", "1", "inn"), (4, "0.1", "0.1", "-3", "inn"), (5, "0.2", "0.2", "1", "mill")],
        "query long, lat string, lon string, rad string, category string",
    )
    assert [r["query"] for r in N.valid_queries(q, n).collect()] == [1]


def test_pairs_of_a_long_map_are_counted_without_rounds_along_it(spark, monkeypatch):
    rng = random.Random(3)
    wide, long = 5, 60
    roads = [(a, b) for a in range(wide * long) for b in (a + 1, a + wide) if b < wide * long and (b != a + 1 or b % wide) and rng.random() < 0.75]
    adj = {}
    for a, b in roads:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    starts = [0, 7, 7, 7, 150, 299]
    want = {}
    for s in starts:
        dist, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for w in adj.get(v, []):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        for v, hops in dist.items():
            steps = abs(v // wide - s // wide) + abs(v % wide - s % wide)
            want[steps, hops] = want.get((steps, hops), 0) + 1
    cuts = []
    for module in (N, N.fold_distances.__globals__):
        real = module["cut"] if isinstance(module, dict) else module.cut
        counted = lambda df, real=real: cuts.append(1) or real(df)
        monkeypatch.setitem(module if isinstance(module, dict) else vars(module), "cut", counted)
    q = spark.createDataFrame(list(enumerate(starts)), "query long, node long")
    e = N.undirected(spark.createDataFrame(roads, "src long, dst long"))
    got = {(r["steps"], r["hops"]): r["pairs"] for r in N.detour_counts(q, e, wide, rows=2).collect()}
    assert got == want
    assert len(cuts) <= 16  # a search along the map took one for every four of its 60 rows, and more


def test_detour_figures_count_every_pair(spark):
    counts = spark.createDataFrame([(1, 1, 3), (1, 3, 1), (2, 2, 6), (0, 0, 9)], "steps long, hops long, pairs long")
    by, whole = N.detours(counts)
    assert {r["steps"]: (r["pairs"], r["same_share"]) for r in by.collect()} == {1: (4, 0.75), 2: (6, 1.0)}
    r = whole.first()
    assert (r["pairs"], r["same_share"], round(r["mean"], 9), r["max"], r["p90"]) == (10, 0.9, 1.2, 3.0, 1.0)


def test_one_way_search_ends_where_no_road_leads_back(spark, monkeypatch):
    """A road of 200 nodes one way: the inn behind the source is ruled out before the road ends."""
    far = 200
    n = spark.createDataFrame([(v, v + 1, v / far, 0.0, "inn" if v in (3, 9, 11) else "well") for v in range(far)], "node long, id long, lat double, lon double, category string")
    e = spark.createDataFrame([(v, v + 1) for v in range(far - 1)], "src long, dst long")
    q = spark.createDataFrame([(i, 7 / far, 0.0, "inn", 0.05, 10, 7) for i in (4, 5, 6)], "query long, lat double, lon double, category string, rad double, k int, source long")
    rounds = []
    monkeypatch.setattr(N, "_advance", lambda *a, real=N._advance: rounds.append(1) or real(*a))
    kinds, members = N.alike(q)
    assert kinds.count() == 1 and {(r["query"], r["asked"]) for r in members.collect()} == {(4, 4), (5, 4), (6, 4)}
    a = N.for_all(N.search(kinds, n, e, F.lit(1), both_ways=False)[0], members)
    assert sorted((r["query"], r["rank"], r["node"], r["hops"]) for r in a.collect()) == sorted((i, k, v, v - 7) for i in (4, 5, 6) for k, v in ((1, 9), (2, 11)))
    assert len(rounds) <= 4


def test_queries_at_one_source_stop_apart(spark):
    roads = [(v, v + 1) for v in range(11)] + [(20, 21)]
    e = N.undirected(spark.createDataFrame(roads, "src long, dst long"))
    src = spark.createDataFrame([(1, 0), (2, 0), (3, 20)], "query long, node long")
    wanted = spark.createDataFrame([(1, 1, 1), (1, 20, 1), (2, 10, 2), (2, 21, 2), (3, 21, 1)], "query long, node long, need long")
    got = {(r["query"], r["node"]): r["hops"] for r in N.hop_distances(src, e, wanted=wanted).collect()}
    assert got[1, 1] == 1 and got[2, 10] == 10 and got[3, 21] == 1 and (2, 21) not in got and (1, 20) not in got


def test_open_pairs_keep_their_measured_size_over_many_rounds(spark, monkeypatch):
    """What is still open is joined with a part of itself every round; its estimated size does not square with it."""
    far, bits = 48, []
    e = spark.createDataFrame([(v, v + 1) for v in range(far)], "src long, dst long")
    src = spark.createDataFrame([(1, far - 2), (2, 1)], "query long, node long")
    wanted = spark.createDataFrame([(1, far - 6, 1), (1, far, 2), (2, far - 1, 1)], "query long, node long, need long")
    for name in ("cut", "cut_sized"):
        real = getattr(N, name, None)
        sized = lambda df, real=real: (out := real(df), bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()))[0]
        monkeypatch.setattr(N, name, sized, raising=False)
    got = {(r["query"], r["node"]): r["hops"] for r in N.hop_distances(src, e, both_ways=False, wanted=wanted).collect()}
    assert got[1, far] == 2 and (1, far - 6) not in got and got[2, far - 1] == far - 2
    assert max(bits) < 4000  # squared every round, it had 4 790 digits before the end


def test_pairs_on_one_way_roads_match_plain_breadth_first(spark):
    """Pieces of ten nodes, three levels of them and four sources at a time give the distance of each pair asked for."""
    rng = random.Random(11)
    wide, long = 5, 60
    steps = [(a, b) for a in range(wide * long) for b in (a + 1, a + wide) if b < wide * long and (b != a + 1 or b % wide)]
    roads = [r for a, b in steps for r in ((a, b), (b, a)) if rng.random() < 0.6]
    roads += [(2, 297), (250, 8)]  # and two that cross the map
    adj = {}
    for a, b in roads:
        adj.setdefault(a, []).append(b)
    starts = [rng.randrange(wide * long) for _ in range(30)] + [7, 7, 412]
    pairs = {(s, min(max(s + rng.randrange(-40, 40), 0), 299)) for s in starts for _ in range(6)} | {(7, 7), (7, 299), (299, 7), (412, 3), (412, 412), (3, 412)}
    want = {}
    for s, v in pairs:
        dist, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for w in adj.get(u, []):
                if w not in dist:
                    dist[w] = dist[u] + 1
                    todo.append(w)
        if v in dist:
            want[s, v] = dist[v]
    e = spark.createDataFrame(roads, "src long, dst long")
    p = spark.createDataFrame(sorted(pairs), "source long, node long")
    told = N.pair_distances(p, e, lambda v: F.floor(v / (2 * wide)), fan=4, chunk=4).collect()
    assert {(r["source"], r["node"]): r["hops"] for r in told} == want and len(told) == len(want)
    assert want[412, 412] == 0 and len(want) < len(pairs)


def test_one_way_search_takes_no_rounds_along_a_long_road(spark, monkeypatch):
    """From the middle of a one-way road of 400 nodes, an inn behind is no longer ruled out by walking to either end."""
    far, cuts = 400, []
    n = spark.createDataFrame([(v, v + 1, v / far, 0.0, "inn" if v in (195, 204) else "well") for v in range(far)], "node long, id long, lat double, lon double, category string")
    e = spark.createDataFrame([(v, v + 1) for v in range(far - 1)], "src long, dst long")
    q = spark.createDataFrame([(1, 200 / far, 0.0, "inn", 0.05, 10, 200)], "query long, lat double, lon double, category string, rad double, k int, source long")
    for module in (vars(N), N.hop_distances.__globals__["pair_distances"].__globals__):
        monkeypatch.setitem(module, "cut", lambda df, real=module["cut"]: cuts.append(1) or real(df))
    a, _, _ = N.search(q, n, e, F.lit(1), both_ways=False)
    assert [(r["node"], r["hops"]) for r in a.collect()] == [(204, 4)]
    assert len(cuts) <= 20  # walking took nine for every four nodes


def test_links_keep_no_column_of_the_whole_map_on_the_driver(spark, tmp_path):
    from rillwork.catalog import network

    sizes = [(v, 1 + v * 37 % 50) for v in range(400)]
    spark.createDataFrame([(v, "LARGE", s) for v, s in sizes], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lk = network.links(spark, str(tmp_path))
    assert "Broadcast" not in lk._jdf.queryExecution().executedPlan().toString()
    size = dict(sizes)
    want = {(v, w) for v in size for w in (v + 1, v + 40) if w in size and (w != v + 1 or w % 40) and abs(size[v] - size[w]) <= 30}
    assert sorted(tuple(r) for r in lk.collect()) == sorted(want)
