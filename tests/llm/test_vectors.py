"""Top-k search and whitening against plain numpy versions."""

import math
import random

import numpy as np
import pytest

from rillwork.llm import top_search, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, q string, score double, dim int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 7, "k", 0.5, 3) for r in rows], schema).repartition(3)


def whole(v):
    return [math.floor(256 * float(c)) for c in v]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def naive_top(rows, k=5, every=50):
    """Sorted result rows; repeated queries once."""
    good = [(i, whole(v)) for i, v in rows if usable(v)]
    out = []
    for i, q in sorted({(i, tuple(x)) for i, x in good if i is not None and i % every == 0}):
        found = [(sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q)]
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def some_vectors(rng, n, dim):
    rows = [(i, [float(np.float32(rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]))) for _ in range(dim)]) for i in range(-n // 4, n)]
    rows += [(rng.randrange(n), rows[3][1]) for _ in range(20)]  # ties and repeated ids
    rows += [(None, rows[5][1])] * 40 + [(10_000, None), (10_050, [None] * dim), (10_100, [float("nan")] * dim), (10_150, [float("inf")] * dim)]
    return rows


def test_search_matches_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    rows = some_vectors(rng, 300, 6) + [(20_000 + i, [1.0, -2.0]) for i in range(3)] + [(20_050, [0.5, 0.5]), (30_000, []), (30_001, [])]
    df = frame(spark, rows)
    got = sorted(map(tuple, top_search.top_scores(df).collect()), key=str)
    assert got == naive_top(rows)
    # many small cells and narrow rounds give the same
    monkeypatch.setattr(top_search, "CELL", 300)
    monkeypatch.setattr(top_search, "BITS", 6)
    monkeypatch.setattr(top_search, "SHEET", 500)
    got = sorted(map(tuple, top_search.top_scores(df.select("vec_id", "embedding"), k=7, every=10).collect()), key=str)
    assert got == naive_top(rows, 7, 10)


def test_search_of_equal_and_huge_vectors(spark):
    rows = [(i, [0.25] * 4) for i in range(120)]
    assert sorted(map(tuple, top_search.top_scores(frame(spark, rows)).collect()), key=str) == naive_top(rows)
    big = [(i, [(-1.0) ** i * 1e5 * (i + 1), 3e4]) for i in range(60)]
    assert sorted(map(tuple, top_search.top_scores(frame(spark, big)).collect()), key=str) == naive_top(big)
    vast = [(0, [3e38]), (1, [1e38]), (2, [-1e38])]
    got = [tuple(r) for r in top_search.top_scores(frame(spark, vast)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_search_without_rows_or_queries(spark):
    for rows in ([], [(1, [1.0])], [(50, None), (51, [1.0])], [(50, [1.0])]):
        assert top_search.top_scores(frame(spark, rows)).collect() == []
    with pytest.raises(ValueError):
        top_search.top_scores(frame(spark, []), k=0)


def naive_white(rows, top=4):
    good = [(i, whole(v)) for i, v in rows if usable(v)]
    x = np.array([v for _, v in good], float)
    fit = np.unique(x, axis=0)
    mean, n = fit.mean(axis=0), len(fit)
    e, c = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    e, c = e[::-1], c[:, ::-1]
    m = min(top, int((e > 1e-10 * e[0]).sum()))
    total = [int(s) for s in fit.sum(axis=0)]
    dev = [sum((n * int(a) - s) ** 2 for a, s in zip(v, total)) for _, v in good]
    return good, e, (x - mean) @ c[:, :m] / np.sqrt(e[:m]), dev, n


def check_white(spark, rows, unique=True):
    got = whitening.whiten(frame(spark, rows)).collect()
    good, e, white, dev, n = naive_white(rows)
    m = white.shape[1]
    assert len(got) == len(good) * m
    assert all(r.n == n and abs(r.identity_error) < 1e-9 for r in got)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got) == sorted((i is None, i or 0, d) for (i, _), d in zip(good, dev) for _ in range(m))
    for c in range(m):
        own = [r for r in got if r.component == c + 1]
        assert all(abs(r.explained - e[c] / e.sum()) < 1e-12 for r in own)
        if unique:
            a = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in own)
            want = [sorted((i is None, i or 0, s * w) for (i, _), w in zip(good, white[:, c])) for s in (1, -1)]
            assert any(np.allclose([t[2] for t in a], [t[2] for t in b], atol=1e-8) for b in want)
    return got


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 9)) * np.array([9, 7, 5, 3, 1, 0.5, 0.2, 0.1, 0.05]) + 4
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += rows[:50] + [(None, rows[7][1]), (900, None), (901, [None] * 9), (902, [float("nan")] * 9)]
    check_white(spark, rows)


def test_whitening_of_low_rank_and_repeated_values(spark):
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(30)]
    assert {r.component for r in check_white(spark, line)} == {1}
    # four directions of equal variance: one run of steps sees one of them only
    cross = [(2 * i + j, [0.0] * i + [3.0 * (1 - 2 * j)] + [0.0] * (5 - i)) for i in range(6) for j in range(2)]
    got = check_white(spark, cross, unique=False)
    assert {r.component for r in got} == {1, 2, 3, 4}
    pairs = cross + [(100 + j, [0.0] * 5 + [9.0 * (1 - 2 * j)]) for j in range(2)]
    check_white(spark, pairs, unique=False)


def test_whitening_early_end(spark):
    """Leading values far above the rest: the steps end before all directions are spent."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24)) * 0.01
    x[:, :4] += rng.standard_normal((300, 4)) * np.array([400, 90, 20, 5])
    check_white(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)])


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
    mixed = [(i, [float(i), float(i * i)]) for i in range(9)] + [(20 + i, [float(i * i * i)]) for i in range(5)]
    assert len(whitening.whiten(frame(spark, mixed)).collect()) == 9 * 2 + 5


def test_deviation_beyond_longs_is_exact_or_null():
    x = np.array([[2**40, 5], [7, -(2**33)]])
    got = whitening._deviation(x, 3, [2**41, 9])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, [2**41, 9])) for row in x.tolist()]
    assert got == [w if w < 2**63 else None for w in want] and got[0] is None
